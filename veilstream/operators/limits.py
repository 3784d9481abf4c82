"""Rate limits by generic cell rate: a recurrence in which a rejected request leaves no trace."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.session import ship_package


class Bucket:
    """State of one key: the theoretical arrival time, in microseconds."""

    def __init__(self, interval_us: int, burst: int, tat: int | None = None):
        self.interval, self.room, self.tat = interval_us, (max(1, burst) - 1) * interval_us, tat

    def allows(self, at_us: int) -> bool:
        tat = at_us if self.tat is None else self.tat
        if at_us < tat - self.room:
            return False
        self.tat = max(tat, at_us) + self.interval
        return True


def rate_limit(events: DataFrame, key_col: str, time_col: str, tie_col: str, interval_us: int, burst: int) -> DataFrame:
    """events (key, time, tie) with ``allowed``, in time order for each key.

    Rows are sorted within partitions and streamed; a task holds the state of one key, however many rows it has.
    """
    ship_package(events.sparkSession)
    rows = events.select(key_col, tie_col, F.unix_micros(F.col(time_col).cast("timestamp")).alias("at_us"))
    dealt = rows.repartition(key_col).sortWithinPartitions(key_col, "at_us", tie_col)

    def judge(batches):
        key, bucket = object(), None
        for batch in batches:
            allowed = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    key, bucket = k, Bucket(interval_us, burst)
                allowed.append(at is not None and bucket.allows(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(allowed, pa.bool_())], names=[key_col, tie_col, "at_us", "allowed"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return dealt.mapInArrow(judge, f"`{key_col}` {kinds[key_col]}, `{tie_col}` {kinds[tie_col]}, at_us long, allowed boolean")
