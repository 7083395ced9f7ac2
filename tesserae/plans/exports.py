"""Exports, checks of records, and the functions on texts, over the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import catalog, vocab
from tesserae.functions import arrow
from tesserae.functions import text as T
from tesserae.operators import consolidate, dedup, exports, integrity, reviews, search, validate
from tesserae.plans import records
from tesserae.session import table
from tesserae.sources import scans


def _picked(values, number) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number % len(values) + 1).cast("int"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each part: category, kind and domain by its number."""
    k = F.col("p_partkey").cast("long")
    kind = F.when(k % 7 == 0, "reference").when(k % 7 == 1, "palette").otherwise("code")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k).alias("id"), k.alias("pos"), F.col("p_name").alias("title"), _picked(vocab.CATEGORIES[:5], k).alias("category"), kind.alias("kind"), F.when(k % 7 > 0, _picked(vocab.DOMAINS, k)).alias("domain"),
        F.when(k % 7 == 1, F.array(F.concat(F.lit("#"), F.lpad((k % 1000).cast("string"), 6, "0")))).alias("colors"),
        F.when(k % 7 == 1, F.concat(F.lit('["#'), F.lpad((k % 1000 + (k % 21 == 1).cast("int")).cast("string"), 6, "0"), F.lit('"]'))).otherwise(F.lit("x")).alias("code"),
    )


def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.collection_counts(_items(spark, sf_dir))


def collection_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.collections(_items(spark, sf_dir)).select("collection", "id")


def palette_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.palette_code_faults(_items(spark, sf_dir))


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = exports.composition(_items(spark, sf_dir), "2026-01-31")
    return spark.createDataFrame(sorted(counts.items()), "part string, n long")


def detail_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = exports.details(_items(spark, sf_dir).select("id", "pos", "category"))
    return files.select("shard", "sha256", "bytes", "count")


def browse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an entry's details are, and what a search of it looks through."""
    items = _items(spark, sf_dir).select("id", "pos", "category", "title", F.lit(None).cast("string").alias("description"))
    _, paths = exports.details(items.select("id", "pos", "category"))
    rows = exports.browse(items, paths)
    return rows.select("id", "search_text", F.count(F.lit(1)).over(exports_window()).alias("beside"))


def exports_window():
    from pyspark.sql import Window

    return Window.partitionBy("detail_shard")


def discovery_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact index of conversations as entries with their later turns as variants."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.lit("code").alias("kind"), F.col("role").alias("title"), F.concat(F.lit("s"), F.col("turn") % 2).alias("sourceName"), F.lit("c").alias("code_sha"), F.lit("r").alias("record_sha"))
    policy = records._members(spark, sf_dir)[1].select("group", "member", "mode").withColumns({"code_sha": F.lit("c"), "record_sha": F.lit("r")})
    parents, _ = consolidate.apply(turns, policy, strict=False)
    rows = exports.discovery(parents)
    return rows.select("id", "title", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ",").alias("aliases"), F.coalesce("variant_count", F.lit(0)).cast("long").alias("variants"), F.coalesce(F.array_join("variant_titles", ","), F.lit("")).alias("titles"), F.coalesce(F.size("variant_source_names"), F.lit(-1)).cast("long").alias("sources"))


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(_picked(reviews.DOMAINS, k).alias("target_domain"), F.when(k % 3 > 0, _picked(reviews.RESOURCES, k)).alias("resource_type"), F.when(k % 2 == 0, "reference").otherwise("loader").alias("asset_type"), F.when(k % 5 > 0, "illustration").alias("preview_mode"))
    return exports.review_counts(rows)


def preview_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of links: of an asset beside them, of a drawing, or of a sheet."""
    items, k = _items(spark, sf_dir), F.col("pos")
    said = items.where("kind = 'reference'").select(
        "id", F.when(k % 3 == 0, "related-asset").otherwise("illustration").alias("mode"), F.concat(F.lit("p"), k + k % 2).alias("assetId"), F.when(k % 2 == 0, "svg").otherwise("css").alias("language"),
        F.when(k % 5 == 0, "<animate/> .a{transition : x}").otherwise("<svg/> .a{top:0}").alias("code"),
    )
    return exports.previewed(said, items).select("id", F.coalesce("preview_domain", F.lit("none")).alias("preview_domain"))


def removal_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals of every third entry; they fit only links that have not changed."""
    items = _items(spark, sf_dir).select("id", "kind", "pos", F.sha2("title", 256).alias("record_sha"))
    k = F.col("pos")
    gone = items.where("pos % 3 = 0").select("id", F.when(k % 2 == 0, F.col("record_sha")).otherwise("x").alias("source_sha256"), F.when(k % 5 == 0, " ").otherwise("closed").alias("reason"), F.when(k % 11 == 0, "dull").otherwise("private").alias("status"), F.lit("2026-01-01").alias("verified_at"))
    return reviews.removal_faults(gone, items).select("id", F.array_join("faults", ",").alias("faults"))


def uncovered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links without just one review: every second has one, every fifth one more."""
    items = _items(spark, sf_dir)
    said = items.where("pos % 2 = 0").select("id").unionByName(items.where("pos % 5 = 0").select("id"))
    return reviews.uncovered(said, items)


def unused_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of every conversation's first turn; only component groups have a use for them."""
    _, policy = records._members(spark, sf_dir)
    heads = table(spark, sf_dir, "conversations").where("turn = 0").select(F.concat_ws(":", "conv_id", "turn").alias("id"))
    return consolidate.unused_repairs(policy, heads)


def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with faults by the number of their part."""
    k = F.col("p_partkey")
    none = lambda kind: F.lit(None).cast(kind)
    off = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    made = {
        "id": off(11, F.concat(F.lit("-"), k), F.concat(F.lit("p"), k)), "title": off(13, F.lit("  "), F.col("p_name")), "description": F.lit("words"), "category": off(17, F.lit("nothing"), F.lit("animation")), "kind": off(5, F.lit("reference"), F.lit("code")),
        "tags": off(19, F.array_repeat(F.lit("t"), 65), F.array(F.lit("t"))), "colors": off(23, F.array(F.lit("red")), none("array<string>")), "sourceUrl": off(29, F.lit("ftp://a"), F.lit("https://example.org/x")), "sourceName": F.lit("Example"), "license": F.lit("MIT"),
        "verifiedAt": F.lit("2026-01-01"), "verification": off(31, none("string"), F.lit("metadata")), "preview": F.struct(F.lit("css").alias("type"), none("string").alias("variant"), none("string").alias("sampleText"), none("string").alias("scene")),
        "code": off(5, F.when(k % 10 == 0, "x"), F.lit(".a{}")), "language": off(37, F.lit("c"), F.lit("css")), "access": off(41, F.lit("private"), F.lit("public")),
    }
    fields = {f.split()[0]: f.split(maxsplit=1)[1] for f in _fields(validate.ITEM)}
    rows = table(spark, sf_dir, "part").select(*(made.get(n, none(t)).alias(n) for n, t in fields.items()), k.alias("k"))
    return validate.validated(rows)[1].select("id", F.array_join(F.array_sort("faults"), ",").alias("faults"))


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search of a turn looks through: its title, and a description as far as the search reads it."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("role").alias("title"), F.col("text").alias("description"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    return rows.select("id", F.sha2(validate.search_text(rows), 256).alias("digest"))


def asset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of all kinds that are equal where their spacing, comments, notation or attributes' order is not."""
    k = F.col("p_partkey")
    kind = _picked(("code", "code", "palette", "reference", "image", "code"), k)
    language = _picked(("css", "svg", "json", "link", "image", "javascript"), k)
    code = (
        F.when(language == "css", F.concat(F.lit("a "), F.repeat(F.lit(" "), (k % 4).cast("int")), F.when(k % 5 == 0, "/* c */ ").otherwise(""), F.lit("{ b: 'c  d"), (k % 3).cast("string"), F.lit("' }")))
        .when(language == "svg", F.when(k % 4 < 2, F.concat(F.lit('<svg b="1" a="'), (k % 3).cast("string"), F.lit('"> <g/></svg>'))).otherwise(F.concat(F.lit('<svg a="'), (k % 3).cast("string"), F.lit('" b="1"><g/> </svg>'))))
        .when(language == "javascript", F.concat(F.lit("run("), (k % 5).cast("string"), F.lit(")")))
    )
    colors = F.when(kind == "palette", F.array(F.when(k % 4 < 2, "#ABC").otherwise("#aabbcc"), F.lit("#0000ff")))
    print_ = dedup.fingerprint(kind, language, code, colors, F.when(k % 8 < 4, F.sha2(F.lit("i"), 256)).otherwise("none"))
    rows = table(spark, sf_dir, "part").select(language.alias("of"), print_.alias("f"))
    sizes = rows.groupBy("of", "f").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("of").agg(F.count_if(F.col("f").isNotNull()).alias("prints"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("f").isNull(), F.col("n"))), F.lit(0)).alias("without"))


def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.when(F.col("n_regionkey") > 1, F.lit("x")).alias("code"), F.array(F.lit("t")).alias("tags"))
    return rows.select("id", catalog.record_digest(rows).alias("record_sha"))


def input_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three inputs below each other, with their places."""
    parts = [(name, table(spark, sf_dir, "nation").where(F.col("n_regionkey") == i).select("n_nationkey", "n_name")) for i, name in enumerate(("a", "b", "c"))]
    parts[2] = (parts[2][0], parts[2][1].drop("n_name"))
    rows = dedup.ordered_union(parts, "n_nationkey")
    return rows.select("input_name", "input_order", "row_order", F.coalesce("n_name", F.lit("")).alias("n_name"))


def payload_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads packed and read again; every seventh is cut short, every eleventh has a byte too many."""
    rows = table(spark, sf_dir, "events").select("event_id", "props", scans.packed("props").alias("p"))
    k = F.col("event_id")
    bent = F.when(k % 7 == 0, F.expr("substring(p, 1, length(p) - 3)")).when(k % 11 == 0, F.concat("p", F.lit(b"x"))).otherwise(F.col("p"))
    back = rows.select("event_id", scans.unpacked(bent).alias("u"))
    return back.select("event_id", F.coalesce(F.array_join(F.array_sort(F.json_object_keys("u.payload")), ","), F.lit("")).alias("names"), F.coalesce("u.error", F.lit("")).alias("error"))


def strict_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that is read, or refused for what it says."""
    k = F.col("s_suppkey")
    text = _picked(('{"a":1}', '{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}', "[1]", '{"a":'), k)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), scans.unpacked(text)["error"].isNull().alias("read"))


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and third line of a text."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.sha2(scans.line_range(F.col("text"), F.lit(2), F.lit(3)), 256).alias("digest"))


@arrow("struct<plain:string,folded:string,composed:string>")
def _texts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(T.terminal_safe(t), t.casefold(), T.fold_text(t)) for t in texts], columns=["plain", "folded", "composed"])


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case, marks, controls and lengths of every text with an escape and a sign beyond the first plane at its end."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" STRASSE Straße\x1b[0m\x85 😀"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(text)).alias("t")).withColumn("p", _texts("t"))
    return rows.select("doc_id", F.sha2("p.plain", 256).alias("plain"), F.sha2("p.folded", 256).alias("folded"), T.utf16_units(F.col("t")).alias("units"), F.sha2(T.nfc("t"), 256).alias("nfc"), F.sha2(T.ascii_lower(F.col("t")), 256).alias("ascii"))


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{ "z": ['), F.col("n_regionkey"), F.lit(' , null], "a" : {"é": "'), "n_name", F.lit('", "b": true} }'))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.canonical(text).alias("json"))


def facet_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have each of two facets."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select("doc_id", F.array(F.concat(F.lit("quality:"), "quality")).alias("q"), F.array(F.concat(F.lit("toxic:"), "toxic"), F.concat(F.lit("lang:"), "lang")).alias("t"))
    return search.filtered(rows, holding={"q": "quality:1", "t": "lang:en"}).select("doc_id")


def stored_in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entries of a domain."""
    return exports.collections(_items(spark, sf_dir)).where("collection = 'domain-design'").select("id")


def rejoined_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a changed copy of the entries lacks and adds."""
    items = _items(spark, sf_dir).select("id", "title", "category")
    other = items.where("id <> 'p7'").withColumn("title", F.when(F.col("id") == "p9", "changed").otherwise(F.col("title")))
    return integrity.differences(items, other).select("id", "side")


ITEMS = f"""
with items as (select 'p' || p_partkey as id, p_partkey as k, p_name as title, [{", ".join(repr(c) for c in vocab.CATEGORIES[:5])}][p_partkey % 5 + 1] as category,
  case when p_partkey % 7 = 0 then 'reference' when p_partkey % 7 = 1 then 'palette' else 'code' end as kind, case when p_partkey % 7 > 0 then [{", ".join(repr(c) for c in vocab.DOMAINS)}][p_partkey % {len(vocab.DOMAINS)} + 1] end as domain from part)
"""
CONTROLS = [c for c in (*range(1, 32), *range(127, 160)) if c not in (9, 10)]
PLAIN = "t"
for _c in CONTROLS:
    PLAIN = f"replace({PLAIN}, chr({_c}), '\\x{_c:02x}')"
QUERIES = {
    f.__name__: f
    for f in (
        collection_counts, collection_members, palette_code, composition, detail_shards, browse_rows, discovery_index, review_counts, preview_domains, removal_faults, uncovered_references, unused_repairs, record_validation, search_text, asset_fingerprints, record_digests, input_union,
        payload_codec, strict_payloads, line_ranges, text_functions, canonical_json, facet_exists, stored_in_domain, rejoined_catalog,
    )
}
SHARDED = f"""{ITEMS}, b as (select k, id, '{{"id":"' || id || '","pos":' || k || ',"category":"' || category || '"}}' as body, (row_number() over (order by k) - 1) // {vocab.SHARD_ITEMS} as shard from items),
f as (select shard, '{exports.HEAD}' || string_agg(body, ',' order by k) || ']}}' || chr(10) as body, count(*) as n from b group by shard)"""
ORACLES = {
    "collection_counts": f"""{ITEMS}, names as (select unnest([{", ".join(repr(c) for c in [*vocab.CATEGORIES, *(f"domain-{d}" for d in vocab.DOMAINS)])}]) as collection)
        select collection, (select count(*) from items where category = collection or (kind <> 'reference' and 'domain-' || domain = collection)) as n from names""",
    "collection_members": f"{ITEMS} select category as collection, id from items union all select 'domain-' || domain, id from items where kind <> 'reference'",
    "palette_code": "select 'p' || p_partkey as id from part where p_partkey % 7 = 1 and p_partkey % 21 = 1",
    "composition": f"{ITEMS} select unnest(['design', 'motion', 'references']) as part, unnest([count(*) filter (kind <> 'reference' and domain = 'design'), count(*) filter (kind <> 'reference' and domain = 'motion'), count(*) filter (kind = 'reference')]) as n from items",
    "detail_shards": f"{SHARDED} select shard, sha256(body) as sha256, strlen(body) as bytes, n as count from f",
    "browse_rows": f"{SHARDED} select id, title || '  ' || id as search_text, count(*) over (partition by shard) as beside from b join items using (id)",
    "discovery_index": f"""{records.TURNS} select g as id, arg_min(role, turn) as title, coalesce(string_agg(id, ',' order by pos) filter (id <> g), '') as aliases, case when n = 1 then 0 when any_value(mode) = 'motion' then count(*) else 1 end as variants,
        case when n = 1 then '' else string_agg(role, ',' order by pos) end as titles, case when n = 1 then -1 else count(distinct turn % 2) end as sources from turns group by g, n""",
    "review_counts": f"""with r as (select [{", ".join(repr(x) for x in reviews.DOMAINS)}][p_partkey % {len(reviews.DOMAINS)} + 1] as d, case when p_partkey % 3 > 0 then [{", ".join(repr(x) for x in reviews.RESOURCES)}][p_partkey % {len(reviews.RESOURCES)} + 1] end as r,
        case when p_partkey % 2 = 0 then 'reference' else 'loader' end as a, case when p_partkey % 5 > 0 then 'illustration' end as p from part where p_partkey % 7 = 0),
        f as (select 'targetDomains' as field, d as value from r union all select 'resourceTypes', r from r union all select 'assetTypes', a from r union all select 'previewModes', p from r union all select 'totals', 'total' from r
          union all select 'totals', 'classified' from r where r is not null union all select 'totals', 'specificAssetTypes' from r where a <> 'reference' union all select 'totals', 'localPreviews' from r where p is not null)
        select field, value, count(*) as n from f where value is not null group by 1, 2""",
    "preview_domains": f"""{ITEMS} select i.id, case when i.k % 3 = 0 then coalesce(a.domain, 'none') when i.k % 5 = 0 then 'motion' else 'design' end as preview_domain from items i left join items a on a.k = i.k + i.k % 2 and a.kind <> 'reference' where i.kind = 'reference'""",
    "removal_faults": f"""{ITEMS}, f as (select id, concat_ws(',', case when kind <> 'reference' then 'no reference' end, case when k % 2 <> 0 then 'record changed' end, case when k % 11 = 0 then 'status' end, case when k % 5 = 0 then 'reason' end) as faults from items where k % 3 = 0)
        select * from f where faults <> ''""",
    "uncovered_references": f"{ITEMS} select id, (k % 2 = 0)::int::bigint + (k % 5 = 0)::int::bigint as reviews from items where kind = 'reference' and (k % 2 = 0)::int + (k % 5 = 0)::int <> 1",
    "unused_repairs": f"{records.TURNS} select id, 'unused' as fault from turns where turn = 0 and (n = 1 or mode <> 'component' or g <> id)",
    "record_validation": """with p as (select p_partkey as k, case when p_partkey % 11 = 0 then '-' else 'p' end || p_partkey as id from part),
        f as (select id, array_to_string(list_sort(list_filter([case when k % 11 = 0 then 'id' end, case when k % 13 = 0 then 'title' end, case when k % 17 = 0 then 'category' end, case when k % 10 = 0 then 'code' end, case when k % 19 = 0 then 'tags' end, case when k % 23 = 0 then 'colors' end,
          case when k % 29 = 0 then 'sourceUrl' end, case when k % 31 = 0 then 'verification' end, case when k % 37 = 0 then 'language' end, case when k % 41 = 0 then 'access' end], lambda x: x is not null)), ',') as faults from p) select * from f where faults <> ''""",
    "search_text": "select conv_id || ':' || turn as id, sha256(role || ' ' || text[1:6000] || ' ' || conv_id || ':' || turn || ' a b') as digest from conversations",
    "asset_fingerprints": """with p as (select p_partkey as k, ['css', 'svg', 'json', 'link', 'image', 'javascript'][p_partkey % 6 + 1] as "of" from part),
        f as (select "of", case "of" when 'css' then 'c' || k % 3 when 'svg' then 's' || k % 3 when 'json' then 'p' when 'image' then case when k % 8 < 4 then 'i' end when 'javascript' then 'j' || k % 5 end as f from p)
        select "of", count(distinct f) as prints, count(*) as n, count(*) filter (f is null) as without from f group by 1""",
    "record_digests": """select 'n' || n_nationkey as id, sha256('{"code":' || case when n_regionkey > 1 then '"x"' else 'null' end || ',"id":"n' || n_nationkey || '","tags":["t"],"title":"' || n_name || '"}') as record_sha from nation""",
    "input_union": "select ['a', 'b', 'c'][n_regionkey + 1] as input_name, n_regionkey as input_order, n_nationkey as row_order, case when n_regionkey < 2 then n_name else '' end as n_name from nation where n_regionkey < 3",
    "payload_codec": "select event_id, case when event_id % 7 = 0 or event_id % 11 = 0 then '' else array_to_string(list_sort(json_keys(props)), ',') end as names, case when event_id % 7 = 0 or event_id % 11 = 0 then 'a truncated, oversized or trailed payload' else '' end as error from events",
    "strict_payloads": "select s_suppkey as id, s_suppkey % 6 = 0 as read from supplier",
    "line_ranges": "select doc_id, sha256(case len(string_split(text, chr(10))) when 1 then '' when 2 then split_part(text, chr(10), 2) when 3 then split_part(text, chr(10), 2) || chr(10) || split_part(text, chr(10), 3) else split_part(text, chr(10), 2) || chr(10) || split_part(text, chr(10), 3) || chr(10) end) as digest from documents",
    "text_functions": f"""with d as (select doc_id, coalesce(text, '') || ' STRASSE Straße' || chr(27) || '[0m' || chr(133) || ' 😀' as t from documents)
        select doc_id, sha256({PLAIN}) as plain, sha256(replace(lower(t), 'ß', 'ss')) as folded, length(t) + len(regexp_extract_all(t, '[\\x{{10000}}-\\x{{10FFFF}}]')) as units, sha256(nfc_normalize(t)) as nfc,
        sha256(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as "ascii" from d""",
    "canonical_json": """select n_nationkey, '{"a":{"b":true,"é":"' || n_name || '"},"z":[' || n_regionkey || ',null]}' as json from nation""",
    "facet_exists": "select doc_id from documents join labels using (doc_id) where quality = 1 and lang = 'en'",
    "stored_in_domain": f"{ITEMS} select id from items where kind <> 'reference' and domain = 'design'",
    "rejoined_catalog": "select * from (values ('p7', 'left'), ('p9', 'left'), ('p9', 'right')) t(id, side)",
}
