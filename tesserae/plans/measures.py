"""Counts, windows, colours, code features and relational forms over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.functions import text as T
from tesserae.operators import passages, shards, stats
from tesserae.operators.audits import glsl, palette
from tesserae.operators.features import css as css_features
from tesserae.operators.features import glsl as glsl_features
from tesserae.scratch import written
from tesserae.session import table


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flags = F.filter(F.array(F.when(F.col("quality") == 1, F.lit("good")), F.when(F.col("toxic") == 1, F.lit("toxic"))), lambda x: x.isNotNull())
    return stats.facet_counts(rows, {"lang": F.col("lang"), "source": F.col("source")}, {"flags": flags})


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_distinct("user_id").alias("users"))


def stats_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return stats.document(stats.facet_counts(rows, {"lang": F.col("lang"), "source": F.col("source")}))


def updated_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.updated_at(table(spark, sf_dir, "events"), "ts")


def share_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return stats.shares(counts, "n", ["p_brand"]).select("p_brand", "n", F.round("share", 6).alias("share"), F.round("start", 6).alias("start"))


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(stats.bands(F.col("l_quantity") / 50.0).alias("band"))
    return stats.zero_filled(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "band", "n", ("<0.5", "<0.8", "<0.9", "<0.97", "<0.985", ">=0.985"))


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.round(F.percentile("p_retailprice", F.lit(0.5)), 6).alias("median"), F.round(F.stddev_pop("p_retailprice"), 4).alias("std"), F.round(F.max("p_retailprice") - F.min("p_retailprice"), 6).alias("spread"))


def vocab_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a user's events, in a vocabulary's order."""
    types = ("purchase", "click", "view", "signup", "error")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("found"))
    return rows.select("user_id", F.array_join(T.in_vocabulary(F.col("found"), types), ",").alias("types"))


def sign_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    steps = table(spark, sf_dir, "events").withColumn("s", F.signum(F.col("value") - F.lag("value").over(w))).where("s <> 0")
    turns = steps.withColumn("turn", (F.col("s") != F.lag("s").over(w)).cast("long"))
    return turns.groupBy("user_id").agg(F.coalesce(F.sum("turn"), F.lit(0)).alias("reversals"))


def coalesced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring equal event types of a user count once."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumn("new", ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)))
    return rows.groupBy("user_id").agg(F.count_if("new").alias("runs"), F.count(F.lit(1)).alias("events"))


def set_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.manifest(table(spark, sf_dir, "nation").select("n_nationkey", F.sha2("n_name", 256).alias("sha")), "n_nationkey", "sha")


def shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return shards.assigned(rows, "doc_id", "size")


def _palettes(spark: SparkSession, sf_dir: str, twins: bool = False) -> DataFrame:
    """Two colours from a vector, each channel from the sum of every sixth component; with ``twins``, each again with one channel a step away."""
    every = lambda i: F.aggregate(F.filter("embedding", lambda _, at: at % 6 == i), F.lit(0.0), lambda s, x: s + x)
    level = lambda i: F.greatest(F.lit(0), F.least(F.lit(7), F.floor((every(i) + 0.5) * 8))).cast("int") * 36
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.explode(F.array(F.array(*(level(i) for i in range(6))))).alias("c"))
    if twins:
        step = lambda x, i: F.when(i == F.col("id") % 6, F.when(x < 252, x + 1).otherwise(x - 1)).otherwise(x)
        rows = rows.unionByName(rows.withColumn("c", F.transform("c", step)).withColumn("id", F.col("id") + 1_000_000))
    pair = [F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(F.get("c", F.lit(i + k))), 2, "0")) for k in range(3))) for i in (0, 3)]
    return rows.select("id", F.array(*pair).alias("colors"))


def _again(rows: DataFrame) -> DataFrame:
    """Every fourth palette once more, and every fifth with its colours turned round."""
    return rows.unionByName(rows.where("id % 4 = 0").withColumn("id", F.col("id") + 2_000_000)).unionByName(rows.where("id % 5 = 0").select((F.col("id") + 3_000_000).alias("id"), F.reverse("colors").alias("colors")))


def palette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.exact_groups(palette.prepared(_again(_palettes(spark, sf_dir)))[0]).select(F.array_join("ids", ",").alias("ids"))


def palette_multiset_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.reordered_families(palette.prepared(_again(_palettes(spark, sf_dir)))[0]).select(F.array_join("ids", ",").alias("ids"))


def palette_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _palettes(spark, sf_dir)
    three = two.where("id % 5 = 0").select((F.col("id") + 1_000_000).alias("id"), F.concat("colors", F.array(F.lit("#102030"))).alias("colors"))
    return palette.subset_pairs(palette.prepared(two.unionByName(three))[0])


def palette_oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = palette.prepared(_palettes(spark, sf_dir))[0]
    return good.select("id", *(F.round(F.col("centroid")[i], 6).alias(f"c{i}") for i in range(6)))


def palette_near_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = palette.classified(written(palette.prepared(_palettes(spark, sf_dir, True))[0], "palettes")).where("relation <> 'candidate-matched'")
    return found.select("a_id", "b_id", "relation", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"))


def palette_centroid_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.near_cells(palette.prepared(_palettes(spark, sf_dir, True))[0]).select("a_id", "b_id")


def palette_near_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes of a third colour as well, and each again a step away with its colours moved on by one."""
    two = _palettes(spark, sf_dir)
    third = F.concat(F.lit("#"), F.substring(F.col("colors")[0], 4, 2), F.substring(F.col("colors")[1], 4, 2), F.substring(F.col("colors")[0], 2, 2))
    three = two.select("id", F.array(F.col("colors")[0], F.col("colors")[1], third).alias("colors"))
    step = F.concat(F.substring(F.col("colors")[0], 1, 6), F.when(F.substring(F.col("colors")[0], 7, 1) == "0", "1").otherwise(F.substring(F.col("colors")[0], 7, 1)))
    turned = three.select((F.col("id") + 1_000_000).alias("id"), F.array(F.col("colors")[1], F.col("colors")[2], step).alias("colors"))
    found = palette.classified(written(palette.prepared(three.unionByName(turned))[0], "palettes")).where("relation = 'candidate-matched'")
    return found.select("a_id", "b_id", F.round("mean", 6).alias("mean"))


def palette_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, errors = palette.prepared(_palettes(spark, sf_dir, True))
    return palette.coverage(good, errors, palette.classified(good))


def token_dice_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages against conversations by runs of five words, as a rare-run probe and a count."""
    found = passages.shared_runs(table(spark, sf_dir, "benchmark"), "item_id", table(spark, sf_dir, "documents"), "doc_id", "text", 5, 0.5)
    return found.select("item_id", "doc_id", "shared")


def _style() -> Column:
    """All sheets of a page."""
    return F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<style[^>]*>(.*?)</style>"), F.lit(1)), "\n")


def css_style_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", _style().alias("css"))
    return rows.select("page_id", F.size(F.regexp_extract_all("css", F.lit(r"([\w-]+)\s*:[^;{}]+"), F.lit(1))).cast("long").alias("declarations"), F.sha2(T.numeric_skeleton(F.col("css")), 256).alias("skeleton"))


def css_page_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", css_features.css_analysis(_style(), F.lit("animation"), F.lit("")).alias("a"))
    return rows.select("page_id", "a.asset_type", F.array_join("a.components", ",").alias("components"), "a.valid")


def _shaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shader for each part, its operations by the part's number."""
    k = F.col("p_partkey")
    body = F.concat(
        F.lit("uniform float amount; // = 0.3\nvec4 transition(vec2 uv) {\n"),
        F.when(k % 2 == 0, "return mix(getFromColor(uv), getToColor(uv), progress);\n").otherwise("float w = sin(uv.x * 9.0); return getToColor(uv + progress * w);\n"),
        F.when(k % 3 == 0, "vec2 q = floor(uv * 8.0);\n").otherwise(""), F.when(k % 5 == 0, "float m = smoothstep(0.1, 0.4, progress);\n").otherwise(""), F.when(k % 7 == 0, "float n = noise(uv);\n").otherwise(""), F.lit("}"),
    )
    return table(spark, sf_dir, "part").select(k.alias("id"), body.alias("code"))


def glsl_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = glsl_features.analysed(_shaders(spark, sf_dir))
    return rows.select("id", F.array_join("effects", ",").alias("effects"), F.array_join("components", ",").alias("components"), F.array_join("techniques", ",").alias("techniques"))


def glsl_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glsl.counted_sources(_shaders(spark, sf_dir))


def hamming_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least Hamming distance of each vector's sign bits to eight fixed codes."""
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when((x > 0) & (i < 63), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    codes = [(1 << 63) // 7 >> k for k in range(8)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_min(F.array(*(F.bit_count(bits.bitwiseXOR(F.lit(c))) for c in codes))).cast("long").alias("distance"))


def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    by = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    rows = by.join(customer, by["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    return rows.groupBy("r_name").agg(F.sum("n").alias("orders"), F.round(F.sum("total"), 2).alias("total"))


def semi_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def anti_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order."""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def grouped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("mean"))


PALETTES = """
with recursive level as (select vec_id as id, list_transform(range(0, 6), lambda k: (greatest(0, least(7, floor((list_reduce(list_prepend(0.0::double, list_filter(embedding::double[], lambda x, i: (i - 1) % 6 = k)), lambda a, b: a + b) + 0.5) * 8)))::int * 36)) as c from embeddings),
twins as (select id, c from level union all select id + 1000000, list_transform(c, lambda x, i: case when i - 1 = id % 6 then case when x < 252 then x + 1 else x - 1 end else x end) from level),
hexes as (select id, list_transform([0, 3], lambda k: '#' || lower(printf('%02x%02x%02x', c[k + 1], c[k + 2], c[k + 3])) || 'ff') as colors, c from {}),
lin as (select *, list_transform(c, lambda v: case when v / 255.0::double <= 0.04045 then v / 255.0::double / 12.92 else pow((v / 255.0::double + 0.055) / 1.055, 2.4) end) as l from hexes),
cone as (select *, list_transform([0, 3], lambda k: [cbrt(0.4122214708::double * l[k+1] + 0.5363325363::double * l[k+2] + 0.0514459929::double * l[k+3]), cbrt(0.2119034982::double * l[k+1] + 0.6806995451::double * l[k+2] + 0.1073969566::double * l[k+3]), cbrt(0.0883024619::double * l[k+1] + 0.2817188376::double * l[k+2] + 0.6299787005::double * l[k+3])]) as m from lin),
lab as (select *, list_transform(m, lambda q: [100 * (0.2104542553::double * q[1] + 0.7936177850::double * q[2] - 0.0040720468::double * q[3]), 100 * (1.9779984951::double * q[1] - 2.4285922050::double * q[2] + 0.4505937099::double * q[3]), 100 * (0.0259040371::double * q[1] + 0.7827717662::double * q[2] - 0.8086757660::double * q[3])]) as v from cone),
cen as (select *, [(v[1][1] + v[2][1]) / 2, (v[1][2] + v[2][2]) / 2, (v[1][3] + v[2][3]) / 2] as z from lab)
"""
ONE, BOTH = PALETTES.format("level"), PALETTES.format("twins")
AGAIN = f"{ONE}, again as (select id, colors from hexes union all select id + 2000000, colors from hexes where id % 4 = 0 union all select id + 3000000, list_reverse(colors) from hexes where id % 5 = 0)"
NEAR_SQL = """,
pair as (select a.id as a_id, b.id as b_id, a.v as av, b.v as bv, list_sort(a.colors) = list_sort(b.colors) as same from cen a join cen b on a.id < b.id and (a.z[1]-b.z[1])^2 + (a.z[2]-b.z[2])^2 + (a.z[3]-b.z[3])^2 <= 1.0 + 1e-12),
dist as (select *, sqrt((av[1][1]-bv[1][1])^2 + (av[1][2]-bv[1][2])^2 + (av[1][3]-bv[1][3])^2) as s1, sqrt((av[2][1]-bv[2][1])^2 + (av[2][2]-bv[2][2])^2 + (av[2][3]-bv[2][3])^2) as s2,
  sqrt((av[1][1]-bv[2][1])^2 + (av[1][2]-bv[2][2])^2 + (av[1][3]-bv[2][3])^2) as t1, sqrt((av[2][1]-bv[1][1])^2 + (av[2][2]-bv[1][2])^2 + (av[2][3]-bv[1][3])^2) as t2 from pair)
"""
QUERIES = {
    f.__name__: f
    for f in (
        facet_counts, event_counts, stats_document, updated_at, share_percent, score_bands, quantiles, vocab_order, sign_reversals, coalesced_runs, set_manifest, shard_packing, palette_exact, palette_multiset_family, palette_subset, palette_oklab,
        palette_near_ordered, palette_centroid_prune, palette_near_permuted, palette_coverage, token_dice_candidates, css_style_rules, css_page_analysis, glsl_facets, glsl_exact_groups, hamming_nearest, join_inner, semi_facet, anti_lost, topk, grouped_counts,
    )
}
ORACLES = {
    "facet_counts": """with d as (select * from documents left join labels using (doc_id)) select 'lang' as field, lang as value, count(*) as n from d group by 2 union all select 'source', source, count(*) from d group by 2
        union all select 'flags', 'good', count(*) from d where quality = 1 having count(*) > 0 union all select 'flags', 'toxic', count(*) from d where toxic = 1 having count(*) > 0""",
    "event_counts": "select event_type, count(*) as n, count(*) filter (value > 50) as high, count(distinct user_id) as users from events group by 1",
    "updated_at": "select max(ts)::date::varchar as updated_at from events",
    "share_percent": "select p_brand, n, round(n * 100.0::double / sum(n) over (), 6) as share, round(coalesce(sum(n * 100.0::double / t) over (order by p_brand rows between unbounded preceding and 1 preceding), 0), 6) as start from (select p_brand, count(*) as n, (select count(*) from part) as t from part group by 1)",
    "score_bands": """select band, count(l_quantity) as n from (values ('<0.5', 0.0, 0.5), ('<0.8', 0.5, 0.8), ('<0.9', 0.8, 0.9), ('<0.97', 0.9, 0.97), ('<0.985', 0.97, 0.985), ('>=0.985', 0.985, 99.0)) b(band, low, high)
        left join lineitem on l_quantity / 50.0::double >= low::double and l_quantity / 50.0::double < high::double group by band""",
    "quantiles": "select p_size, round(quantile_cont(p_retailprice, 0.5), 6) as median, round(stddev_pop(p_retailprice), 4) as std, round(max(p_retailprice) - min(p_retailprice), 6) as spread from part group by 1",
    "vocab_order": "select user_id, array_to_string(list_filter(['purchase', 'click', 'view', 'signup', 'error'], lambda v: list_contains(f, v)), ',') as types from (select user_id, list(distinct event_type) as f from events group by 1)",
    "sign_reversals": """with s as (select user_id, event_id, sign(value - lag(value) over (partition by user_id order by event_id)) as s from events), k as (select * from s where s <> 0)
        select user_id, coalesce(sum(turn), 0)::bigint as reversals from (select user_id, (s <> lag(s) over (partition by user_id order by event_id))::int as turn from k) group by 1""",
    "coalesced_runs": "select user_id, count(*) filter (p is distinct from event_type) as runs, count(*) as events from (select *, lag(event_type) over (partition by user_id order by event_id) as p from events) group by 1",
    "set_manifest": """select sha256('[' || string_agg('["' || n_nationkey || '","' || sha256(n_name) || '"]', ',' order by n_nationkey::varchar) || ']') as manifest from nation""",
    "shard_packing": f"""with recursive d as (select doc_id, strlen(text) as s, row_number() over (order by doc_id) as n from documents),
        w as (select n, doc_id, s as used, 1 as held, 0::bigint as shard from d where n = 1
          union all select d.n, d.doc_id, case when w.held = {vocab.SHARD_ITEMS} or w.used + d.s > {vocab.SHARD_BYTES} then d.s else w.used + d.s end,
            case when w.held = {vocab.SHARD_ITEMS} or w.used + d.s > {vocab.SHARD_BYTES} then 1 else w.held + 1 end,
            case when w.held = {vocab.SHARD_ITEMS} or w.used + d.s > {vocab.SHARD_BYTES} then w.shard + 1 else w.shard end from w join d on d.n = w.n + 1)
        select doc_id, shard from w""",
    "palette_exact": f"{AGAIN} select string_agg(id::varchar, ',' order by id) as ids from again group by colors having count(*) > 1",
    "palette_multiset_family": f"{AGAIN} select string_agg(id::varchar, ',' order by id) as ids from again group by list_sort(colors) having count(distinct colors) > 1",
    "palette_subset": f"""{ONE}, three as (select id + 1000000 as id, list_append(colors, '#102030ff') as colors from hexes where id % 5 = 0)
        select a.id as short_id, b.id as long_id from hexes a join three b on case when a.colors[1] = a.colors[2] then len(list_filter(b.colors, lambda x: x = a.colors[1])) >= 2 else list_contains(b.colors, a.colors[1]) and list_contains(b.colors, a.colors[2]) end""",
    "palette_oklab": f"{ONE} select id, round(z[1], 6) as c0, round(z[2], 6) as c1, round(z[3], 6) as c2, round(z[1], 6) as c3, round(z[2], 6) as c4, round(z[3], 6) as c5 from cen",
    "palette_centroid_prune": f"{BOTH}{NEAR_SQL} select a_id, b_id from pair",
    "palette_near_ordered": f"""{BOTH}{NEAR_SQL} select a_id, b_id, case when near then 'near' else 'candidate-reversed' end as relation, round(case when near then (s1 + s2) / 2 else (t1 + t2) / 2 end, 6) as mean, round(case when near then greatest(s1, s2) else greatest(t1, t2) end, 6) as most
        from (select *, (s1 + s2) / 2 <= 1 and greatest(s1, s2) <= 2 as near, (t1 + t2) / 2 <= 1 and greatest(t1, t2) <= 2 as back from dist where not same) where near or back""",
    "token_dice_candidates": r"""with w as (select 'b' as k, item_id as id, regexp_extract_all(lower(text), '([\p{L}\p{N}]+)') as t from benchmark union all select 'd', doc_id, regexp_extract_all(lower(text), '([\p{L}\p{N}]+)') from documents),
        runs as (select distinct k, id, array_to_string(t[i:i+4], ' ') as run from (select k, id, t, unnest(range(1, len(t) - 3)) as i from w)),
        n as (select id, count(*) as n from runs where k = 'b' group by 1)
        select a.id as item_id, b.id as doc_id, count(*) as shared from runs a join runs b on a.run = b.run and a.k = 'b' and b.k = 'd' join n on n.id = a.id group by a.id, b.id, n.n having count(*) * 2 >= n.n""",
    "css_style_rules": r"""with s as (select page_id, array_to_string(regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1), chr(10)) as css from pages)
        select page_id, len(regexp_extract_all(css, '([\w-]+)\s*:[^;{}]+', 1)) as declarations, sha256(regexp_replace(css, '[-+]?(?:\d*\.\d+|\d+)', '#', 'g')) as skeleton from s""",
    "glsl_facets": """select p_partkey as id,
        array_to_string(list_filter(['fade', 'slide', 'mask', 'glitch', 'pixel', 'wave'], lambda e: case e when 'fade' then p_partkey % 2 = 0 when 'slide' then p_partkey % 2 = 1 when 'mask' then p_partkey % 5 = 0 when 'glitch' then p_partkey % 7 = 0 when 'pixel' then p_partkey % 3 = 0 else p_partkey % 2 = 1 end), ',') as effects,
        array_to_string(list_filter(['image', 'grid', 'mask', 'layer'], lambda e: case e when 'grid' then p_partkey % 3 = 0 when 'mask' then p_partkey % 5 = 0 else true end), ',') as components,
        array_to_string(list_filter(['glsl', 'texture-sampling', 'procedural-noise'], lambda e: case e when 'procedural-noise' then p_partkey % 7 = 0 else true end), ',') as techniques from part""",
    "glsl_exact_groups": "select count(*) as members, min(p_partkey) as first_id from part group by p_partkey % 2, p_partkey % 3 = 0, p_partkey % 5 = 0, p_partkey % 7 = 0 having count(*) > 1",
    "palette_near_permuted": f"""{ONE}, three as (select id, [substr(colors[1], 1, 7), substr(colors[2], 1, 7), '#' || substr(colors[1], 4, 2) || substr(colors[2], 4, 2) || substr(colors[1], 2, 2)] as h from cen),
        every as (select id, h from three union all select id + 1000000, [h[2], h[3], substr(h[1], 1, 6) || case when substr(h[1], 7, 1) = '0' then '1' else substr(h[1], 7, 1) end] from three),
        rgb as (select id, h, list_transform(h, lambda x: list_transform([2, 4, 6], lambda p: ((position(substr(x, p, 1) in '0123456789abcdef') - 1) * 16 + position(substr(x, p + 1, 1) in '0123456789abcdef') - 1) / 255.0::double)) as c from every),
        l3 as (select id, h, list_transform(c, lambda x: list_transform(x, lambda v: case when v <= 0.04045 then v / 12.92 else pow((v + 0.055) / 1.055, 2.4) end)) as l from rgb),
        m3 as (select id, h, list_transform(l, lambda l: [cbrt(0.4122214708::double * l[1] + 0.5363325363::double * l[2] + 0.0514459929::double * l[3]), cbrt(0.2119034982::double * l[1] + 0.6806995451::double * l[2] + 0.1073969566::double * l[3]), cbrt(0.0883024619::double * l[1] + 0.2817188376::double * l[2] + 0.6299787005::double * l[3])]) as m from l3),
        v3 as (select id, h, list_transform(m, lambda q: [100 * (0.2104542553::double * q[1] + 0.7936177850::double * q[2] - 0.0040720468::double * q[3]), 100 * (1.9779984951::double * q[1] - 2.4285922050::double * q[2] + 0.4505937099::double * q[3]), 100 * (0.0259040371::double * q[1] + 0.7827717662::double * q[2] - 0.8086757660::double * q[3])]) as v from m3),
        z3 as (select *, list_transform([1, 2, 3], lambda i: (v[1][i] + v[2][i] + v[3][i]) / 3) as z from v3),
        d3 as (select a.id as a_id, b.id as b_id, list_transform([1, 2, 3], lambda i: list_transform([1, 2, 3], lambda j: sqrt((a.v[i][1] - b.v[j][1])^2 + (a.v[i][2] - b.v[j][2])^2 + (a.v[i][3] - b.v[j][3])^2))) as d
          from z3 a join z3 b on a.id < b.id and list_sort(a.h) <> list_sort(b.h) and (a.z[1] - b.z[1])^2 + (a.z[2] - b.z[2])^2 + (a.z[3] - b.z[3])^2 <= 1.0 + 1e-12),
        o3 as (select a_id, b_id, list_transform([[1, 2, 3], [3, 2, 1], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2]], lambda p: [d[1][p[1]], d[2][p[2]], d[3][p[3]]]) as o from d3),
        c3 as (select a_id, b_id, list_transform(o, lambda x: case when list_max(x) <= 2 then (x[1] + x[2] + x[3]) / 3 end) as means from o3)
        select a_id, b_id, round(list_min(means), 6) as mean from c3 where list_min(means) <= 1 and coalesce(means[1] > 1, true) and coalesce(means[2] > 1, true)""",
    "palette_coverage": f"""{BOTH}{NEAR_SQL}, r as (select (s1 + s2) / 2 <= 1 and greatest(s1, s2) <= 2 as near, (t1 + t2) / 2 <= 1 and greatest(t1, t2) <= 2 as back from dist where not same)
        select (select count(*) from hexes) as palettes, (select count(*) * (count(*) - 1) // 2 from hexes) as pairs, 0::bigint as errors, (select count(*) from r where near) as near, (select count(*) from r where back and not near) as candidate_reversed, 0::bigint as candidate_matched""",
    "hamming_nearest": f"""with b as (select vec_id, list_reduce(list_prepend(0::bigint, list_transform(embedding[1:63], lambda x, i: case when x > 0 then 1::bigint << (i - 1)::int else 0::bigint end)), lambda a, x: a + x) as bits from embeddings)
        select vec_id, list_min(list_transform([{", ".join(str((1 << 63) // 7 >> k) for k in range(8))}], lambda c: bit_count(xor(bits, c::bigint))))::bigint as distance from b""",
    "stats_document": """with c as (select 'lang' as field, lang as value, count(*) as n from documents group by 2 union all select 'source', source, count(*) from documents group by 2),
        m as (select field, '{' || string_agg('"' || value || '":' || n, ',' order by value) || '}' as m from c where value is not null group by 1)
        select '{' || string_agg('"' || field || '":"' || replace(m, '"', '\\"') || '"', ',' order by field) || '}' as stats from m""",
    "join_inner": """select r_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""",
    "semi_facet": "select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)",
    "anti_lost": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 200000)",
    "topk": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "grouped_counts": "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_quantity), 6) as mean from lineitem group by 1, 2",
}
