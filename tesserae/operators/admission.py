"""Rate limits: at most so many admitted calls of a key within a sliding window.

A call that is refused does not count, and one that is exactly a window old has
left it, so what is admitted depends on what was before: a range window only
gives the calls made, not those admitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae import vocab


#: Windows of time that are one cell.
CELL = 64


def sessions(rows: DataFrame, window: int) -> DataFrame:
    """Adds ``since`` to rows (key, n, at): the first time of the calls without a gap of a window that the row belongs to.

    What is a window old has left it, so such a run begins with nothing, whoever called
    before. Runs are found within cells of the time axis; the one window over all of a
    key has a row for each of its cells.
    """
    cell = F.floor(F.col("at") / F.lit(CELL * window)).cast("long")
    own = Window.partitionBy("key", "cell").orderBy("at", "n")
    dealt = rows.withColumn("cell", cell).withColumn("before", F.lag("at").over(own))
    dealt = dealt.withColumn("cut", F.when(F.col("at") - F.col("before") >= window, F.col("at"))).drop("before")
    ends = dealt.groupBy("key", "cell").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("cut").alias("cut"))
    along = Window.partitionBy("key").orderBy("cell")
    gap = F.col("first") - F.lag("last").over(along)
    ends = ends.withColumn("opens", F.when(gap.isNull() | (gap >= window), F.col("first")))
    earlier = F.last(F.coalesce("cut", "opens"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    entry = ends.select(F.col("key").alias("_key"), F.col("cell").alias("_cell"), F.coalesce("opens", earlier).alias("entry"))
    met = dealt.join(entry, F.col("key").eqNullSafe(F.col("_key")) & (F.col("cell") == F.col("_cell")))
    latest = F.last("cut", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return met.select("key", "n", "at", F.coalesce(latest, F.col("entry")).alias("since"))


def admitted(calls: DataFrame, key: str = "user_id", at: str = "ts", order: str = "event_id", most: int = vocab.RATE_CALLS, seconds: int = vocab.RATE_SECONDS) -> DataFrame:
    """Adds ``admitted``. Each run of calls without a gap of a window streams by in order, so a key's calls spread over tasks.

    All that is kept is the last ``most`` admitted times of the run at hand. A call without a time is refused.
    """
    rows = calls.select(F.col(key).alias("key"), F.col(order).alias("n"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window, count = object(), [0] * most, 0  # admitted so far; window is a ring of their times
        for batch in batches:
            ok = []
            for k, since, t in zip(batch["key"], batch["since"], batch["at"], strict=True):
                mine = (None if pd.isna(k) else k, since)
                if mine != now:
                    now, count = mine, 0
                free = count < most or t - window[count % most] >= seconds * 1_000_000
                if free:
                    window[count % most] = t
                    count += 1
                ok.append(free)
            yield pd.DataFrame({"key": batch["key"], "n": batch["n"], "admitted": ok})

    kinds = rows.schema["key"].dataType.simpleString(), rows.schema["n"].dataType.simpleString()
    timed = sessions(rows.where("at is not null"), seconds * 1_000_000)
    out = timed.repartition("key", "since").sortWithinPartitions("key", "since", "at", "n").mapInPandas(run, f"key {kinds[0]}, n {kinds[1]}, admitted boolean")
    out = out.unionByName(rows.where("at is null").select("key", "n", F.lit(False).alias("admitted")))
    return out.select(F.col("key").alias(key), F.col("n").alias(order), "admitted")


def made(calls: DataFrame, key: str = "user_id", at: str = "ts", seconds: int = vocab.RATE_SECONDS) -> DataFrame:
    """Adds ``recent``, the calls of the key in the half-open window that ends with the row."""
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("recent", F.count(F.lit(1)).over(w)).drop("_at")
