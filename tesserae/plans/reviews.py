"""Reviews of stored scripts and preview trees, over documents and the elements of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.operators import dom, recheck, source_reviews
from tesserae.session import table

SVG = '<svg xmlns="http://www.w3.org/2000/svg"><circle r="5"/></svg>'


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a stored script: its text is the code. What is wrong with a record or its review follows from the number of the document; what is wrong with the text, from the text."""
    k, text = F.col("doc_id"), F.col("text")
    off = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    lit, sha = F.lit, lambda c: F.sha2(c, 256)
    file = lambda name, path: F.struct(F.concat(lit("data/upstream/expansion12-docs/"), path).alias("path"), sha(name).alias("sha256"))
    effect = F.element_at(F.array(*map(lit, vocab.EFFECTS)), (k % len(vocab.EFFECTS) + 1).cast("int"))
    lines = F.size(F.split(F.coalesce(text, lit("")), "\n"))
    picture = F.when(k % 7 == 0, F.struct(lit("illustration").alias("mode"), lit("css").alias("language"), lit(".a{opacity:1}").alias("code"), lit("CC0-1.0").alias("license"), lit("own work").alias("notice"), lit("us").alias("attribution"), F.array(lit("a sketch")).alias("limitations"), F.struct(lit("p").alias("tag"), F.substring(text, 1, 80).alias("text")).alias("dom"))).otherwise(
        F.struct(off(31, "source", "illustration").alias("mode"), lit("svg").alias("language"), lit(SVG).alias("code"), off(37, "MIT", "CC0-1.0").alias("license"), lit("own work").alias("notice"), lit("us").alias("attribution"), F.array(lit("a drawing")).alias("limitations"), lit(None).cast("struct<tag:string,text:string>").alias("dom"))
    )
    review = F.struct(
        off(41, 2, 1).alias("version"),
        F.when(k % 11 == 0, sha(F.concat(text, lit(" ")))).otherwise(sha(text)).alias("sourceSha256"),
        off(43, "main", F.substring(sha("lang"), 1, 40)).alias("revision"),
        F.struct(off(29, lines + 1, lit(1)).alias("startLine"), lines.alias("endLine")).alias("sourceRange"),
        F.struct(off(47, "tooling", "motion").alias("domain"), lit("animation").alias("assetType"), off(23, F.array(effect, effect), F.array(effect)).alias("effects"), F.array(lit("shape")).alias("components"), F.array(lit("intro")).alias("useCases"), F.array(lit("transform")).alias("techniques")).alias("classification"),
        F.struct(lit("reviewed-source").alias("basis"), off(53, "low", "high").alias("confidence"), lit("요약").alias("summaryKO"), F.substring(text, 1, 300).alias("summaryEN"), F.array(F.concat(lit("starts with "), F.substring(text, 1, 60))).alias("signals")).alias("evidence"),
        F.array(F.concat(lit("source "), "source")).alias("dependencies"),
        off(59, F.array().cast("array<string>"), F.array(lit("no scene"))).alias("limitations"),
        picture.alias("preview"),
        F.when(k % 61 == 0, "x").alias("more"),
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), k).alias("id"), off(67, "palette", "code").alias("kind"), lit("javascript").alias("language"), lit("motion").alias("domain"), text.alias("code"),
        off(17, " ", F.concat(lit("MIT, from "), "source")).alias("licenseText"), F.struct(off(19, "css", "reference").alias("type")).alias("preview"),
        F.struct(lit(1).alias("version"), file("source", off(71, F.concat(lit("../"), "source"), F.concat(F.col("source"), lit(".js")))).alias("original"), file("lang", lit("LICENSE")).alias("notice"), off(13, sha("lang"), sha(text)).alias("storedSha256")).alias("collectionEvidence"),
        F.to_json(review).alias("sourceReview"),
    )


def source_review_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each stored script and its review, good ones included."""
    return source_reviews.checked(_stored(spark, sf_dir)).select("id", F.array_join("faults", ",").alias("faults"))


def source_review_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed scripts without a fault, by the classification that their review gives."""
    rows = _stored(spark, sf_dir)
    sound = source_reviews.checked(rows).where(F.size("faults") == 0).select("id")
    made = source_reviews.analysis(rows.join(sound, "id", "left_semi"))
    return made.groupBy(F.element_at("effects", 1).alias("effect"), "basis", "confidence").agg(F.count(F.lit(1)).alias("scripts"), F.sum(F.size("signals")).alias("signals"))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's elements with the text behind their tag, twelve to a section: anchors, items and bold words under names that a preview has, paragraphs and headings as they are."""
    named = F.create_map(*map(F.lit, ("p", "p", "h1", "h1", "b", "strong", "a", "span", "li", "label", "ul", "ul")))
    found = F.regexp_extract_all("html", F.lit("<(p|h1|b|a|li|ul)(?: [^>]*)?>([^<]*)"), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit("<(p|h1|b|a|li|ul)(?: [^>]*)?>([^<]*)"), F.lit(2))
    some = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.arrays_zip(found.alias("t"), texts.alias("x"))).alias("i", "e"))
    tag = F.when((F.col("e.t") == "ul") & (F.col("page_id") % 3 > 0), F.lit("div")).otherwise(named[F.col("e.t")])
    return some.select("page_id", "i", tag.alias("tag"), F.col("e.x").alias("text"), F.when(F.col("page_id") % 5 == 0, F.substring_index("e.x", " ", 1)).alias("className"))


def preview_tree_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each page's elements as an illustration's tree: sections of twelve under one node."""
    node = F.struct("i", F.struct("tag", "className", "text").alias("node"))
    sections = _elements(spark, sf_dir).groupBy("page_id", F.floor(F.col("i") / 12).alias("s")).agg(F.array_sort(F.collect_list(node)).alias("n"))  # twelve
    section = F.struct("s", F.struct(F.lit("div").alias("tag"), F.col("n.node").alias("children")).alias("node"))
    trees = sections.groupBy("page_id").agg(F.array_sort(F.collect_list(section)).alias("n"))  # the elements of one page
    found = trees.select("page_id", dom.illustration_tree(F.to_json(F.struct(F.lit("div").alias("tag"), F.col("n.node").alias("children")))).alias("f"))
    return found.select("page_id", "f.nodes", F.coalesce("f.fault", F.lit("")).alias("fault"))


def catalog_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the parts by language, and of the whole: parts add up, and the order of rows is nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    whole = recheck.digest(docs)
    parts = [recheck.digest(docs.where(F.coalesce("lang", F.lit("")) == lang)) for lang in sorted(r["lang"] or "" for r in docs.select("lang").distinct().collect())]  # the languages of the table: a closed few
    again = recheck.digest(docs.repartition(7, "doc_id"))
    rows = [(whole[0], sum(p[0] for p in parts) == whole[0] and sum(p[1] for p in parts) == whole[1] and sum(p[2] for p in parts) == whole[2], again == whole)]
    return spark.createDataFrame(rows, "records long, parts_add_up boolean, order_is_nothing boolean")


QUERIES = {f.__name__: f for f in (source_review_faults, source_review_classes, preview_tree_faults, catalog_guard)}

#: A text that holds something, and no control character but tabs and line ends.
_SAID = "(t is not null and regexp_matches(t, '[^\\s]') and not regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]'))"
_START = lambda n: f"(regexp_matches(coalesce(t[1:{n}], ''), '[^\\s]') and not regexp_matches(coalesce(t[1:{n}], ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]'))"
_CLEAN60 = "(t is not null and not regexp_matches(t[1:60], '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]'))"
_FAULTS = f"""
stored as (select doc_id as k, text as t, coalesce(length(text) - length(replace(text, chr(10), '')) + 1, 1) as lines, lang, source from documents),
judged as (
  select 'd' || k as id, k, lines, list_filter([
    case when k % 67 = 0 then 'kind' end,
    case when not {_SAID} then 'code' end,
    case when k % 17 = 0 or source is null then 'licenseText' end,
    case when k % 19 = 0 then 'preview type' end,
    case when k % 61 = 0 or t is null then 'fields' end,
    case when k % 41 = 0 then 'version' end,
    case when k % 43 = 0 or lang is null then 'revision' end,
    case when t is null then 'sourceSha256' end,
    case when k % 11 = 0 or t is null then 'stale' end,
    case when k % 13 = 0 or k % 71 = 0 or t is null then 'receipt' end,
    case when k % 29 = 0 then 'sourceRange' end,
    case when k % 23 = 0 or k % 47 = 0 then 'classification' end,
    case when k % 53 = 0 or not {_START(300)} or not {_CLEAN60} then 'evidence' end,
    case when source is null then 'dependencies' end,
    case when k % 59 = 0 then 'limitations' end,
    case when case when k % 7 = 0 then length(t) > 64 else k % 31 = 0 or k % 37 = 0 end then 'illustration' end
  ], lambda x: x is not null) as faults from stored)
"""

ORACLES = {
    "source_review_faults": f"with {_FAULTS} select id, array_to_string(faults, ',') as faults from judged",
    "source_review_classes": f"with {_FAULTS} select [{', '.join(repr(e) for e in vocab.EFFECTS)}][k % {len(vocab.EFFECTS)} + 1] as effect, 'reviewed-source' as basis, 'high' as confidence, count(*) as scripts, count(*) * 6 as signals from judged where len(faults) = 0 group by 1",
    "preview_tree_faults": """
with found as (
  select page_id, regexp_extract_all(html, '<(p|h1|b|a|li|ul)(?: [^>]*)?>([^<]*)', 1) as t, regexp_extract_all(html, '<(p|h1|b|a|li|ul)(?: [^>]*)?>([^<]*)', 2) as x from pages),
elements as (select page_id, unnest(range(len(t))) as i, unnest(t) as t, unnest(x) as x, len(t) as n from found),
judged as (
  select page_id, i, n, i // 12 as s, i % 12 as j, 3 + i + i // 12 as seen,
         case when t = 'ul' and page_id % 3 = 0 then 'tag'
              when page_id % 5 = 0 and split_part(x, ' ', 1) <> '' and (length(split_part(x, ' ', 1)) > 180 or not regexp_full_match(split_part(x, ' ', 1), '[A-Za-z_][A-Za-z0-9_-]*')) then 'className'
              when length(x) > 64 then 'text' end as own
  from elements),
faults as (
  -- a node beyond the budget has no fault of its own; the node before it in order was the last to be seen
  select page_id, case when seen > 64 then seen - 1 else seen end as at, case when seen > 64 and j = 0 and seen - 1 > 64 then s || ':nodes' when seen > 64 then s || '.' || j || ':nodes' else s || '.' || j || ':' || own end as fault,
         case when seen > 64 then case when j = 0 and seen - 1 > 64 then 64 else least(seen - 1, 64) end else seen end as nodes, i
  from judged where own is not null or seen > 64),
first as (select page_id, arg_min(struct_pack(nodes := nodes, fault := fault), i) as f from faults group by page_id),
sizes as (select page_id, max(n) as n from elements group by page_id)
select page_id, case when ceil(n / 12) > 32 then 1 when f is null then 1 + n + ceil(n / 12)::bigint else f.nodes end::bigint as nodes,
       case when ceil(n / 12) > 32 then ':children' else coalesce(f.fault, '') end as fault
from sizes left join first using (page_id)
""",
    "catalog_guard": "select count(*) as records, true as parts_add_up, true as order_is_nothing from documents",
}
