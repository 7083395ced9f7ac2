"""Checks of a published catalog: each gives rows that speak against it, none if it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def not_partitioned(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Keys that are not in just one part, or are in a part but not in the whole."""
    rows = parts[0].select(key)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(key))
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return whole.select(key).distinct().withColumn("there", F.lit(True)).join(counted, key, "full").where("n is null or n <> 1 or there is null").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("there", F.lit(False)).alias("there"))


def field_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field of rows that differ, and keys that one side lacks (field null)."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    lost = F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()
    names = F.filter(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    out = both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(F.when(lost, F.array(F.lit(None).cast("string"))).otherwise(names)).alias("field"))
    return out


def alias_faults(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases that are ids themselves, name no item, or are given twice."""
    ids = items.select("id")
    own = aliases.join(ids, aliases["alias"] == ids["id"], "left_semi").select("alias", F.lit("is an id").alias("fault"))
    lost = aliases.join(ids, aliases["item_id"] == ids["id"], "left_anti").select("alias", F.lit("names no item").alias("fault"))
    twice = aliases.groupBy("alias").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("alias", F.lit("given twice").alias("fault"))
    return own.unionByName(lost).unionByName(twice)


def pinned(rows: DataFrame, pins: DataFrame, key: str, digest: str) -> DataFrame:
    """Pins whose row is missing or has another digest."""
    a = rows.select(F.col(key).alias("_key"), F.col(digest).alias("_found"))
    return pins.join(a, pins[key] == a["_key"], "left").where(~F.col(digest).eqNullSafe(F.col("_found"))).select(key, digest, F.col("_found").alias("found"))
