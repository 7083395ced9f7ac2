"""Identities, de-duplication, consolidation and integrity over ``pages``, ``documents``, ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.functions import urls
from tesserae.operators import admission, consolidate, dedup, integrity
from tesserae.operators.audits import exact
from tesserae.session import table
from tesserae.sources import scans


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and decorated copies of each third: same page, another spelling of its address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))
    joint = F.when(F.col("url").contains("?"), "&").otherwise("?")
    decorated = pages.where("page_id % 3 = 0").select((F.col("page_id") + 1_000_000).alias("page_id"), F.concat(F.regexp_replace("url", "^https?://", "HTTPS://"), joint, F.lit("utm_source=feed&b=2&a=1#top")).alias("url"), F.upper("title").alias("title"))
    plain = pages.where("page_id % 3 = 0").select((F.col("page_id") + 2_000_000).alias("page_id"), F.concat("url", joint, F.lit("a=1&b=2")).alias("url"), "title")
    return pages.unionByName(decorated).unionByName(plain)


def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


def project_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir)
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://GitHub.com/Owner"), F.col("page_id") % 7, F.lit("/Repo/tree/main"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://polyhaven.com/a/"), "page_id")).otherwise(F.col("url"))
    return rows.select("page_id", urls.project_url(url).alias("project"))


def normalized_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.normalized_url(F.col("url")).alias("normal"))


def count_distinct_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).agg(F.count_distinct(urls.canonical_url(F.col("url"))).alias("links"), F.count(F.lit(1)).alias("pages"))


def dedup_url_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a canonical URL and caseless title; of pages of one number, that of the least address."""
    kept = dedup.first_wins(_pages(spark, sf_dir), [urls.canonical_url(F.col("url")), T.casefold(F.trim("title"))], ["page_id", "url"])
    return kept.select("page_id", "url")


def last_wins_then_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of a user and type, in the order in which these were first seen."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    last = dedup.last_wins(rows, ["user_id", "event_type"], ["event_id"])
    return last.select("user_id", "event_type", F.col("event_id").alias("last_id"), "value", F.col("first_place.event_id").alias("first_id"))


def fingerprint_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code"))
    return exact.bodies(rows).select(F.col("ids")[0].alias("first_id"), F.size("ids").cast("long").alias("members"), F.array_join("ids", ",").alias("ids"))


def first_wins_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a further input: texts of even ids are known, the others are accepted once each."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"), F.lit(0).alias("input_order"), F.col("doc_id").alias("row_order"), F.col("source").alias("input_name"))
    _, out, _ = dedup.merge(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))
    return out.select("id", "same_as", "input_name")


def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"), F.lit(0).alias("input_order"), F.col("doc_id").alias("row_order"), F.col("source").alias("input_name"))
    return dedup.merge(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))[2]


def whitespace_normalised_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("members")).where("members > 1")


def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.source_registry(_pages(spark, sf_dir), "url", ["page_id"]).select("source_id", "project", F.col("page_id").alias("last_page"), "records")


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.lit("code").alias("kind"), "conv_id", "role", F.sha2("text", 256).alias("code_sha"), F.sha2(F.concat("role", "text"), 256).alias("record_sha")
    )
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    some = turns.join(sizes, "conv_id")
    groups = consolidate.groups_of(some, "conv_id", "pos", "id")
    policy = groups.join(some.select(F.col("id").alias("member"), "code_sha", "record_sha", "conv_id"), "member").withColumn("mode", F.when(F.col("conv_id") % 2 == 0, "motion").otherwise("component")).drop("conv_id")
    return turns.drop("conv_id"), policy


def consolidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, policy = _members(spark, sf_dir)
    parents, _ = consolidate.apply(items, policy, strict=False)
    return parents.select("id", F.coalesce("mode", F.lit("")).alias("mode"), F.coalesce(F.array_join("aliases", ","), F.lit("")).alias("aliases"), F.greatest("variant_count", F.lit(0)).cast("long").alias("variants"))


def consolidation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.report(_members(spark, sf_dir)[1])


def original_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, policy = _members(spark, sf_dir)
    return consolidate.originals(consolidate.apply(items, policy, strict=False)[0])


def policy_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy in which every seventh conversation's bodies have changed since."""
    items, policy = _members(spark, sf_dir)
    stale = policy.withColumn("code_sha", F.when(F.split("group", ":")[0].cast("long") % 7 == 0, F.lit("0")).otherwise(F.col("code_sha")))
    return consolidate.faults(items, stale)


def collection_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents are put in two collections: just these are found."""
    docs = table(spark, sf_dir, "documents")
    return integrity.not_partitioned(docs, [docs.where(F.col("lang") == c) for c in ("en", "fr", "de", "es")] + [docs.where("lang = 'en' and doc_id < 100")], "doc_id")


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return integrity.differences(docs.select("lang", "source"), docs.where("doc_id % 10 <> 3").select("lang", "source"))


def field_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    changed = docs.where("doc_id % 50 <> 7").withColumn("lang", F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang"))).withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 13 == 0).cast("int"))
    return integrity.field_differences(docs, changed, "doc_id", ["lang", "source", "n_chars"]).select("doc_id", F.coalesce("field", F.lit("")).alias("field"))


def rate_limit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.admitted(table(spark, sf_dir, "events"), most=5, seconds=86_400)


def rate_calls_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.made(table(spark, sf_dir, "events"), seconds=86_400).select("event_id", "recent")


def payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of events, packed and unpacked by the codec."""
    back = table(spark, sf_dir, "events").select("event_id", scans.unpacked(scans.packed("props")).alias("u"))
    keys = F.json_object_keys("u.payload")
    return back.select("event_id", F.size(keys).cast("long").alias("fields"), F.array_join(F.array_sort(keys), ",").alias("names"))


def reference_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.references(_cards(spark, sf_dir))[0].select("url", "card", F.array_join("ids", ",").alias("ids"))


def reference_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.references(_cards(spark, sf_dir))[1].select("url", F.array_join("ids", ",").alias("ids"), "cards")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    copies = pages.where("page_id % 4 = 0").select((F.col("page_id") + 1_000_000).alias("id"), F.regexp_replace("url", "^https", "HTTPS").alias("sourceUrl"), F.when(F.col("page_id") % 8 == 0, "b").alias("sourceCardId"))
    return pages.select(F.col("page_id").alias("id"), F.col("url").alias("sourceUrl"), F.lit(None).cast("string").alias("sourceCardId")).unionByName(copies)


PAGES = r"""
with pages0 as (select page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, case when contains(url, '?') then '&' else '?' end as j from pages),
p as (
  select page_id, url, title from pages0
  union all select page_id + 1000000, regexp_replace(url, '^https?://', 'HTTPS://') || j || 'utm_source=feed&b=2&a=1#top', upper(title) from pages0 where page_id % 3 = 0
  union all select page_id + 2000000, url || j || 'a=1&b=2', title from pages0 where page_id % 3 = 0)
"""


def _canon(url: str) -> str:
    part = rf"regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', %d)"
    kept = f"list_sort(list_filter(string_split({part % 4}, '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid)(=|$)')))"
    query = f"list_transform({kept}, lambda x: case when contains(x, '=') then x else x || '=' end)"
    path = f"case when regexp_replace({part % 3}, '/+$', '') = '' then '/' else regexp_replace({part % 3}, '/+$', '') end"
    return f"(lower({part % 1}) || '://' || lower({part % 2}) || {path} || case when len({kept}) > 0 then '?' || array_to_string({query}, '&') else '' end)"


TURNS = """
with turns as (select conv_id || ':' || turn as id, conv_id, turn, conv_id * 100 + turn as pos, count(*) over (partition by conv_id) as n,
                      first_value(conv_id || ':' || turn) over (partition by conv_id order by turn) as g,
                      case when conv_id % 2 = 0 then 'motion' else 'component' end as mode, role, text from conversations)
"""
QUERIES = {
    f.__name__: f
    for f in (
        canonical_url, project_url, normalized_url, count_distinct_canonical_url, dedup_url_title, last_wins_then_first_wins, fingerprint_exact_groups, first_wins_antijoin, merge_counts, whitespace_normalised_groups, source_registry, consolidate_groups,
        consolidation_report, original_views, policy_faults, collection_partition_check, set_difference, set_equality, field_reconciliation, rate_limit_admission, rate_calls_made, payload_decode, reference_exact, reference_family,
    )
}
MERGE = """
with d as (select doc_id as id, sha256(text) as f, source as input_name from documents),
k as (select f, min(id) as known from d where id % 2 = 0 group by f),
m as (select d.*, known, min(id) over (partition by d.f) as first_id from d left join k using (f) where id % 2 = 1)
"""
PROJECT = "case when page_id % 4 = 0 then 'https://github.com/owner' || page_id % 7 || '/repo' when page_id % 4 = 1 then 'https://polyhaven.com' else {} end"
CARDS = """
with c as (select page_id as id, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) || substr(url, length(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) + 1) as url, '' as card from pages
  union all select page_id + 1000000, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) || substr(url, length(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) + 1), case when page_id % 8 = 0 then 'b' else '' end from pages where page_id % 4 = 0)
"""
ORACLES = {
    "canonical_url": f"{PAGES} select page_id, {_canon('url')} as canonical from p",
    "project_url": f"{PAGES} select page_id, {PROJECT.format(_canon('url'))} as project from p",
    "normalized_url": f"{PAGES} select page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || substr(url, length(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) + 1) as normal from p",
    "count_distinct_canonical_url": f"{PAGES} select count(distinct {_canon('url')}) as links, count(*) as pages from p",
    "dedup_url_title": f"{PAGES} select page_id, url from (select *, row_number() over (partition by {_canon('url')}, replace(lower(trim(title)), 'ß', 'ss') order by page_id, url) as n from p) where n = 1",
    "last_wins_then_first_wins": "select user_id, event_type, max(event_id) as last_id, arg_max(value, event_id) as value, min(event_id) as first_id from events group by 1, 2",
    "fingerprint_exact_groups": "select min(doc_id) as first_id, count(*) as members, string_agg(doc_id::varchar, ',' order by doc_id) as ids from documents group by sha256(text) having count(*) > 1",
    "first_wins_antijoin": f"{MERGE} select id, coalesce(known, first_id) as same_as, input_name from m where known is not null or id <> first_id",
    "merge_counts": f"{MERGE} select input_name, count(*) as received, count(*) filter (known is null and id = first_id) as accepted, count(*) filter (known is not null or id <> first_id) as excluded from m group by 1",
    "whitespace_normalised_groups": r"select sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) as digest, count(*) as members from documents group by 1 having count(*) > 1",
    "source_registry": f"{PAGES} select 'src-' || sha256(project)[1:12] as source_id, project, max(page_id) as last_page, count(*) as records from (select page_id, {_canon('url')} as project from p) group by project",
    "consolidate_groups": f"{TURNS} select g as id, case when n > 1 then any_value(mode) else '' end as mode, coalesce(string_agg(id, ',' order by pos) filter (id <> g), '') as aliases, case when n = 1 then 0 when any_value(mode) = 'motion' then count(*) else 1 end as variants from turns group by g, n",
    "consolidation_report": f"{TURNS} select mode, count(distinct g) as groups, count(*) as members, count(*) - count(distinct g) as removed from turns where n > 1 group by mode",
    "original_views": f"{TURNS} select id, g as parent_id from turns",
    "policy_faults": f"{TURNS} select distinct g as group, 'code changed' as fault from turns where n > 1 and conv_id % 7 = 0",
    "collection_partition_check": "select doc_id, 2 as n, true as there from documents where lang = 'en' and doc_id < 100",
    "set_difference": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "set_equality": "select lang, source, 'left' as side from documents where doc_id % 10 = 3",
    "field_reconciliation": """select doc_id, '' as field from documents where doc_id % 50 = 7
        union all select doc_id, 'lang' from documents where doc_id % 50 <> 7 and doc_id % 9 = 0
        union all select doc_id, 'n_chars' from documents where doc_id % 50 <> 7 and doc_id % 13 = 0""",
    "rate_calls_made": "select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row) as recent from events",
    "rate_limit_admission": """with recursive e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
        w as (select user_id, event_id, n, [t] as held, true as ok from e where n = 1
          union all select e.user_id, e.event_id, e.n, case when len(list_filter(held, lambda x: e.t - x < 86400000000)) < 5 then list_append(list_filter(held, lambda x: e.t - x < 86400000000), e.t) else list_filter(held, lambda x: e.t - x < 86400000000) end,
            len(list_filter(held, lambda x: e.t - x < 86400000000)) < 5 from w join e on e.user_id = w.user_id and e.n = w.n + 1)
        select user_id, event_id, ok as admitted from w""",
    "payload_decode": "select event_id, len(json_keys(props)) as fields, array_to_string(list_sort(json_keys(props)), ',') as names from events",
    "reference_exact": f"{CARDS} select url, card, string_agg(id::varchar, ',' order by id) as ids from c group by url, card having count(*) > 1",
    "reference_family": f"{CARDS} select url, string_agg(id::varchar, ',' order by id) as ids, count(distinct card) as cards from c group by url having count(distinct card) > 1",
}
