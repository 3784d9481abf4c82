"""Rate limits over a stream: the state of a key is its theoretical arrival time, and goes when the key is idle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilstream.operators.limits import Bucket
from veilstream.session import ship_package


def rate_limit_stream(events: DataFrame, key_col: str, interval_us: int, burst: int, idle_ms: int = 3_600_000) -> DataFrame:
    """(key, at_us, allowed) of a stream with columns key_col and at_us; events of a trigger are taken in order of time.

    A key's events of one trigger are sorted as 8 bytes each; limit what a trigger reads where one key can have very many.
    The state goes by processing time: see unredact_stream on batches without data.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship_package(events.sparkSession)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(interval_us, burst, state.get[0] if state.exists else None)
        times = np.sort(np.concatenate([f["at_us"].to_numpy(dtype="int64") for f in frames]))
        for a in range(0, len(times), 10_000):
            part = times[a : a + 10_000]
            yield pd.DataFrame({"key": [key[0]] * len(part), "at_us": part, "allowed": [bucket.allows(at) for at in part.tolist()]})
        state.update((bucket.tat,))
        state.setTimeoutDuration(idle_ms)

    kind = events.schema[key_col].dataType.simpleString()
    return events.groupBy(key_col).applyInPandasWithState(step, f"key {kind}, at_us long, allowed boolean", "tat long", "append", GroupStateTimeout.ProcessingTimeTimeout)
