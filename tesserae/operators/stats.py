"""Counts of a catalog: facets, distinct sources, dates, shares, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet_counts(rows: DataFrame, scalars: dict[str, Column], arrays: dict[str, Column] | None = None) -> DataFrame:
    """field, value, n over scalar and array facets in one pass: facets become rows, which one aggregation counts."""
    one = [F.array(F.struct(F.lit(name).alias("field"), c.cast("string").alias("value"))) for name, c in scalars.items()]
    many = [_values(name, c) for name, c in (arrays or {}).items()]
    return rows.select(F.explode(F.concat(*one, *many)).alias("f")).where("f.value is not null").groupBy("f.field", "f.value").agg(F.count(F.lit(1)).alias("n"))


def _values(name: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("field"), v.cast("string").alias("value")))


def document(counts: DataFrame) -> DataFrame:
    """One row: for each field a map from value to count, as JSON with sorted keys."""
    maps = counts.groupBy("field").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("m"))
    return maps.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.to_json("m").alias("m")))))).alias("stats"))


def updated_at(rows: DataFrame, date: str) -> DataFrame:
    """The greatest date prefix, today if there is none."""
    return rows.agg(F.coalesce(F.max(F.substring(F.col(date).cast("string"), 1, 10)), F.date_format(F.current_date(), "yyyy-MM-dd")).alias("updated_at"))


def shares(counts: DataFrame, n: str, order: list[str]) -> DataFrame:
    """Adds the percentage of the whole and the offset at which its slice starts. A row for each value, so one window holds them."""
    whole = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(n).over(whole)
    share = F.when(total == 0, F.lit(0.0)).otherwise(F.col(n) * 100.0 / total)
    return counts.withColumn("share", share).withColumn("start", F.coalesce(F.sum(share).over(before), F.lit(0.0)))


def bands(value: Column, edges: tuple[float, ...] = (0.5, 0.8, 0.9, 0.97, 0.985)) -> Column:
    """The band of a score, named by its upper edge."""
    out = F.when(value < edges[0], f"<{edges[0]}")
    for edge in edges[1:]:
        out = out.when(value < edge, f"<{edge}")
    return out.otherwise(f">={edges[-1]}")


def zero_filled(counts: DataFrame, field: str, n: str, values: tuple[str, ...]) -> DataFrame:
    spark = counts.sparkSession
    return spark.createDataFrame([(v,) for v in values], f"{field} string").join(counts, field, "left").withColumn(n, F.coalesce(n, F.lit(0)).cast("long"))


def manifest(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """One digest of a set of (key, digest), whatever its order."""
    return rows.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.array(F.col(key).cast("string"), F.col(digest))))), 256).alias("manifest"))
