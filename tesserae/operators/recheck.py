"""The recheck of a catalog: every audit over the canonical entries, held against earlier decisions.

Findings of all domains are rows of one shape (domain, section, a_id, b_id, a_sha,
b_sha), so coverage, decisions and the verdict are one aggregation each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.audits import css, exact, glsl, palette, svg
from tesserae.scratch import written

DOMAINS = ("css", "svg", "glsl", "palette", "reference", "javascript", "image")


def domain_of() -> Column:
    """The audit that a record belongs to."""
    coded = F.col("language").isin("css", "svg", "glsl", "javascript")
    return F.when(F.col("kind").isin("palette", "reference", "image"), F.col("kind")).when((F.col("kind") == "code") & coded, F.col("language")).otherwise("other")


class CoverageError(RuntimeError):
    """Records that no audit has seen."""


class CatalogMovedError(RuntimeError):
    """The catalog is not what it was when the recheck began."""


def digest(items: DataFrame) -> tuple:
    """Rows, and the sum and the exclusive or of two hashes of each: the same for the same records in any order and any partitions.

    Parts of a catalog can be summed on their own. A row is hashed with the names of its columns.
    """
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(items.columns))), {"ignoreNullFields": "false"})
    one, two = F.xxhash64(row), F.xxhash64(F.lit("again"), row)
    sums = [F.sum(h.cast("decimal(20,0)")).alias(f"sum_{i}") for i, h in enumerate((one, two))]
    return tuple(items.agg(F.count(F.lit(1)).alias("rows"), *sums, F.bit_xor(one).alias("mixed")).head())  # one row


def _pairs(domain: str, section: Column | str, pairs: DataFrame) -> DataFrame:
    return pairs.select(F.lit(domain).alias("domain"), (section if isinstance(section, Column) else F.lit(section)).alias("section"), "a_id", "b_id")


def _star(classes: DataFrame) -> DataFrame:
    """Members of a class beside the least of it."""
    return classes.where("first_id <> id").select(F.col("first_id").alias("a_id"), F.col("id").alias("b_id"))


def _same(rows: DataFrame, *by: Column) -> DataFrame:
    """first_id and id of rows that agree in all of ``by``."""
    keyed = rows.select("id", *(c.alias(f"_k{i}") for i, c in enumerate(by)))
    keys = [f"_k{i}" for i in range(len(by))]
    firsts = keyed.groupBy(*keys).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(firsts, keys).select("first_id", "id")


def findings(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (domain, section, a_id, b_id) and what was seen (domain, id, signature, error).

    ``items`` has id, kind, language, code, colors, sourceUrl and, where there are any,
    sourceCardId, image and preview. Equal records are held by the least of them.
    """
    of = lambda name: items.where(domain_of() == name)
    seen: list[DataFrame] = []
    found: list[DataFrame] = []

    def saw(domain: str, rows: DataFrame, signature: str | Column, error: Column | None = None) -> None:
        mark = F.col(signature) if isinstance(signature, str) else signature
        seen.append(rows.select(F.lit(domain).alias("domain"), "id", mark.cast("string").alias("signature"), (F.lit(None) if error is None else error).cast("string").alias("error")))

    sheets = written(css.prepared(of("css")), "sheets")
    saw("css", sheets, "exact", F.col("error"))
    found += [_pairs("css", "exact", _star(css.classes(sheets, "exact"))), _pairs("css", "candidate", css.candidates(sheets)), _pairs("css", "family", _star(css.classes(sheets, "motion", "timeless")))]
    near = css.classes(sheets, "timeless", "exact").join(sheets.select("id", "exact"), "id").groupBy("first_id", "exact").agg(F.min("id").alias("id"))
    found.append(_pairs("css", "near", _star(near)))

    drawings = written(svg.prepared(of("svg")), "drawings")
    saw("svg", drawings, "exact", F.col("error"))
    found.append(_pairs("svg", F.regexp_extract("relation", "^[a-z]+", 0), svg.pairs(drawings)))

    shaders = glsl.prepared(of("glsl"))
    saw("glsl", shaders, F.sha2("exact", 256), F.col("error"))
    sound = shaders.where("error is null")
    found += [_pairs("glsl", "exact", _star(_same(sound, F.col("exact")))), _pairs("glsl", "candidate", glsl.folded_candidates(shaders))]

    good, bad = (written(x, "palettes") for x in palette.prepared(of("palette")))
    saw("palette", good, "ordered")
    saw("palette", bad, F.lit(None), F.col("error"))
    found += [_pairs("palette", "exact", _star(_same(good, F.col("ordered")))), _pairs("palette", F.regexp_extract("relation", "^[a-z]+", 0), palette.classified(good))]

    links = of("reference")
    card = F.coalesce("sourceCardId", F.lit("")) if "sourceCardId" in items.columns else F.lit("")
    saw("reference", links, F.sha2("sourceUrl", 256))
    found.append(_pairs("reference", "exact", _star(_same(links, exact.link(F.col("sourceUrl")), card))))
    scripts = of("javascript")
    saw("javascript", scripts, F.sha2("code", 256))
    found.append(_pairs("javascript", "exact", _star(_same(scripts, F.sha2("code", 256)))))
    if "image" in items.columns:
        pictures = of("image")
        saw("image", pictures, "image.sha256")
        found.append(_pairs("image", "exact", _star(_same(pictures, F.col("image.sha256")))))
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, seen)


def reported(found: DataFrame) -> DataFrame:
    """Findings in the order of a report."""
    return found.orderBy("domain", "section", "a_id", "b_id")


def uncovered(items: DataFrame, seen: DataFrame) -> DataFrame:
    """domain, id of records that an audit should have seen and has not, or has seen without one."""
    want = items.select(domain_of().alias("domain"), "id").where(F.col("domain").isin(*DOMAINS))
    got = seen.select("domain", "id")
    return want.exceptAll(got).unionByName(got.exceptAll(want))


def recheck(items: DataFrame, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings with their decision, the summary by domain and section, and whether all is passed (one row).

    A decision (domain, a_id, b_id, a_sha, b_sha, decision) holds only while both
    signatures are what they were. Exact and near findings, errors and candidates
    without a decision do not pass. The catalog must be the same when all is found as it
    was before: else this raises CatalogMovedError.
    """
    before = digest(items)
    found, seen = (written(x, name) for x, name in zip(findings(items), ("findings", "seen"), strict=True))
    if (lost := uncovered(items, seen).head()) is not None:
        raise CoverageError(f"{lost['domain']}: {lost['id']}")
    side = lambda p: seen.select("domain", F.col("id").alias(f"{p}_id"), F.col("signature").alias(f"{p}_sha"))
    marked = found.join(side("a"), ["domain", "a_id"]).join(side("b"), ["domain", "b_id"])
    if decisions is None:
        decisions = items.sparkSession.createDataFrame([], "domain string, a_id string, b_id string, a_sha string, b_sha string, decision string")
    decided = written(exact.decided(marked, decisions), "decided")
    errors = seen.where("error is not null").select("domain", F.lit("error").alias("section"), F.lit(False).alias("reviewed"))
    rows = decided.select("domain", "section", F.col("decision").isNotNull().alias("reviewed")).unionByName(errors)
    summary = rows.groupBy("domain", "section").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("reviewed")).alias("open"))
    fails = F.when(F.col("section").isin("exact", "near", "error"), F.col("n")).when(F.col("section") == "candidate", F.col("open")).otherwise(0)
    verdict = summary.agg(F.coalesce(F.sum(fails), F.lit(0)).alias("faults")).withColumn("passed", F.col("faults") == 0)
    if digest(items) != before:
        raise CatalogMovedError("the catalog has changed while it was rechecked")
    return decided, summary, verdict
