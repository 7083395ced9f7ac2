"""First-wins and last-wins keys, fingerprints, and merging of further inputs."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import arrow
from tesserae.functions import text as T
from tesserae.functions import urls


def ordered_union(inputs: list[tuple[str, DataFrame]], position: str) -> DataFrame:
    """All inputs below each other, with their name, their place in the list and the row's ``position`` in its input."""
    rows = [df.withColumn("input_name", F.lit(name)).withColumn("input_order", F.lit(i)).withColumn("row_order", F.col(position)) for i, (name, df) in enumerate(inputs)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each key's last row, with ``first_place``, the order of its first."""
    others = [c for c in rows.columns if c not in key]
    at = F.struct(*(F.col(c) for c in order))
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*(F.col(c) for c in others)), at).alias("_row"), F.min(at).alias("first_place"))
    return best.select(*key, *(F.col(f"_row.{c}").alias(c) for c in others), "first_place")


def first_wins(rows: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key; its window is cut before the exchange."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deduplicate(rows: DataFrame, order: str = "row_order") -> DataFrame:
    """Base records: the last of an id, then the first of a canonical URL and caseless title."""
    unique = last_wins(rows, ["id"], [order])
    return first_wins(unique, [urls.canonical_url(F.col("sourceUrl")), T.casefold(F.trim("title"))], ["first_place"]).drop("first_place")


def plain_svg(text: str) -> str:
    """An SVG without insignificant white space and with sorted attributes; what is no SVG stays as it is."""
    if "<!doctype" in text.lower() or "<!entity" in text.lower():
        return text
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return text
    stack = [root]
    while stack:
        node = stack.pop()
        ordered = sorted(node.attrib.items())
        node.attrib.clear()
        node.attrib.update(ordered)
        node.text = node.text if node.text and node.text.strip() else None
        node.tail = node.tail if node.tail and node.tail.strip() else None
        stack.extend(node)
    return ElementTree.tostring(root, encoding="unicode")


@arrow("string")
def svg_normal(texts: pd.Series) -> pd.Series:
    return texts.map(plain_svg, na_action="ignore")


def short_hex(color: Column) -> Column:
    bare = F.lower(F.regexp_replace(color, "^#+", ""))
    return F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)


def fingerprint(kind: Column, language: Column, code: Column, colors: Column, image_sha256: Column) -> Column:
    """struct<language, digest> of an asset's content; null for what has none."""
    body = F.when(language == "css", T.one_space(code)).when(language == "svg", svg_normal(code)).otherwise(code)
    palette = F.array_join(F.transform(colors, short_hex), ",")
    made = lambda name, digest: F.struct(name.alias("language"), digest.alias("digest"))
    return (
        F.when(kind == "reference", F.lit(None))
        .when(kind == "image", F.when(image_sha256.rlike(r"^[a-f0-9]{64}\z"), made(F.lit("image"), image_sha256)))
        .when(kind == "palette", F.when(F.size(colors) > 0, made(F.lit("palette"), F.sha2(palette, 256))))
        .when(F.trim(F.coalesce(code, F.lit(""))) != "", made(language, F.sha2(body, 256)))
    )


def merge(existing: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Further inputs against known ones, all with id, fingerprint, input_order, row_order.

    What is known, or came earlier, is excluded with the id it equals. Returns the
    accepted rows, the excluded (id, same_as) and counts by input.
    """
    known = existing.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min_by("id", F.struct("input_order", "row_order")).alias("_known"))
    printed = more.where(F.col("fingerprint").isNotNull())
    firsts = printed.groupBy("fingerprint").agg(F.min_by("id", F.struct("input_order", "row_order")).alias("_first"), F.min(F.struct("input_order", "row_order")).alias("_at"))
    ranked = printed.join(known, "fingerprint", "left").join(firsts, "fingerprint")
    ranked = ranked.withColumn("_n", F.when(F.struct("input_order", "row_order") == F.col("_at"), 1).otherwise(2)).drop("_at")
    # what has no content is nobody's copy, and never meets in one task
    bare = more.where(F.col("fingerprint").isNull()).withColumn("_known", F.lit(None).cast(dict(existing.dtypes)["id"])).withColumn("_first", F.col("id")).withColumn("_n", F.lit(1))
    ranked = ranked.unionByName(bare)
    accepted = F.col("_known").isNull() & (F.col("_n") == 1)
    kept = ranked.where(accepted).drop("_known", "_first", "_n")
    out = ranked.where(~accepted).select("id", F.coalesce("_known", "_first").alias("same_as"), "input_name")
    counts = ranked.groupBy("input_name").agg(F.count(F.lit(1)).alias("received"), F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("excluded"))
    return kept, out, counts


def collisions(existing: DataFrame, more: DataFrame) -> DataFrame:
    """Ids that both sides have: an error of the inputs."""
    return more.select("id").intersect(existing.select("id"))


def source_registry(rows: DataFrame, url: str, order: list[str]) -> DataFrame:
    """One row for each project: its id, the last record that names it, and how many do."""
    keyed = rows.withColumn("project", urls.project_url(F.col(url)))
    last = last_wins(keyed, ["project"], order)
    n = keyed.groupBy("project").agg(F.count(F.lit(1)).alias("records"))
    return last.join(n, "project").withColumn("source_id", F.concat(F.lit("src-"), F.substring(F.sha2("project", 256), 1, 12)))
