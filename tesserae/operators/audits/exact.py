"""Exact groups by digest: JavaScript bodies, images, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import urls


def groups(rows: DataFrame, key: str, value: Column, least: int = 2) -> DataFrame:
    """ids (sorted) of rows with one value."""
    return rows.where(value.isNotNull()).groupBy(value.alias("_v")).agg(F.sort_array(F.collect_list(key)).alias("ids")).where(F.size("ids") >= least).select("ids")


def bodies(rows: DataFrame) -> DataFrame:
    return groups(rows, "id", F.sha2("code", 256))


def link(url: Column) -> Column:
    """What two addresses must agree in to be one link."""
    return urls.normalized_url(url)


def references(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Same link and card, and same link with several cards."""
    keyed = rows.select("id", urls.normalized_url(F.col("sourceUrl")).alias("url"), F.coalesce("sourceCardId", F.lit("")).alias("card"))
    same = keyed.where("url is not null").groupBy("url", "card").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1).select("url", "card", "ids")
    family = keyed.where("url is not null").groupBy("url").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count_distinct("card").alias("cards")).where("cards > 1").select("url", "ids", "cards")
    return same, family


def decided(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds ``decision`` to (domain, a_id, b_id, a_sha, b_sha) where an earlier one is of the same digests."""
    low, high = F.least("a_id", "b_id"), F.greatest("a_id", "b_id")
    old = decisions.select(F.col("domain").alias("d"), low.alias("l"), high.alias("h"), F.when(F.col("a_id") <= F.col("b_id"), F.col("a_sha")).otherwise(F.col("b_sha")).alias("ls"), F.when(F.col("a_id") <= F.col("b_id"), F.col("b_sha")).otherwise(F.col("a_sha")).alias("hs"), "decision")
    new = pairs.withColumn("_l", low).withColumn("_h", high).withColumn("_ls", F.when(F.col("a_id") <= F.col("b_id"), F.col("a_sha")).otherwise(F.col("b_sha"))).withColumn("_hs", F.when(F.col("a_id") <= F.col("b_id"), F.col("b_sha")).otherwise(F.col("a_sha")))
    same = (F.col("domain") == F.col("d")) & (F.col("_l") == F.col("l")) & (F.col("_h") == F.col("h")) & (F.col("_ls") == F.col("ls")) & (F.col("_hs") == F.col("hs"))
    return new.join(old, same, "left").select(*pairs.columns, "decision")


def summary(findings: DataFrame) -> DataFrame:
    """By domain from (domain, section, n, reviewed): totals, and whether nothing is open."""
    open_ = F.col("section").isin("exact", "near", "error") | (~F.col("reviewed") & (F.col("section") == "candidate"))
    return findings.groupBy("domain").agg(F.sum("n").alias("n"), F.bool_and(~open_ | (F.col("n") == 0)).alias("passed"))
