"""The mapping over a stream of values: one state for each value, which goes when its entry expires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.session import ship_package


def mapping_stream(values: DataFrame, ttl_seconds: int) -> DataFrame:
    """(real_hash, at_us, synthetic, fresh) of a stream of values (real, category, at_us).

    A value keeps its synthetic value, and with it the category that saw it first, until ``ttl_seconds`` after it was made; a use
    does not prolong it. A value's uses of one trigger are taken in order of time, at most 24 bytes each. The state is
    dropped by processing time: see unredact_stream on batches without data.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship_package(values.sparkSession)
    ttl = ttl_seconds * 1_000_000

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        category, expires = state.get if state.exists else (None, 0)
        uses = pd.concat([f[["at_us", "category"]].astype({"category": "category"}) for f in frames]).sort_values(["at_us", "category"], kind="stable")
        out = []
        for at, name in zip(uses["at_us"].tolist(), uses["category"].tolist()):
            fresh = category is None or at >= expires
            if fresh:
                category, expires = name, at + ttl
            out.append((key[0], at, f"{category}_{key[0][:8]}", fresh))
        state.update((category, expires))
        state.setTimeoutDuration(max(1, ttl_seconds) * 1000)
        yield pd.DataFrame(out, columns=["real_hash", "at_us", "synthetic", "fresh"])

    keyed = values.select(F.sha2("real", 256).alias("real_hash"), "category", F.col("at_us").cast("long").alias("at_us"))
    return keyed.groupBy("real_hash").applyInPandasWithState(
        step, "real_hash string, at_us long, synthetic string, fresh boolean", "category string, expires long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
