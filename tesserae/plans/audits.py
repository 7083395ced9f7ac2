"""Audits and classifications over sheets, drawings and palettes that follow from the numbers of suppliers and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.functions import arrow, css
from tesserae.functions import text as T
from tesserae.functions.matching import sequence_ratio
from tesserae.operators import recheck as rechecks
from tesserae.operators.audits import css as css_audit
from tesserae.operators.audits import exact, glsl, palette
from tesserae.operators.audits import svg as svg_audit
from tesserae.operators.features import css as css_features
from tesserae.operators.features import svg as svg_features
from tesserae.plans import measures
from tesserae.scratch import written
from tesserae.session import spread, table


def _text(template: str, **values) -> F.Column:
    """A template with columns put in: ``{name}`` stands for one."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), "id")


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each supplier k: seconds 1 + k % 3, width 10 * (1 + k % 4), a step of 0.505 where 5 divides k, a further rule where 7 does."""
    k = F.col("id")
    body = _text(
        ".c<k> < width: {w}px; animation: a{k} {s}s ease infinite > @keyframes a{k} < from < opacity: 0 > 50% < opacity: {m} > to < opacity: 1 > >".replace("<k>", "{k}"),
        k=k, w=10 * (1 + k % 4), s=1 + k % 3, m=F.when(k % 5 == 0, "0.505").otherwise("0.5"),
    )
    more = F.when(k % 7 == 0, _text(" .c{k}::before < content: 'a further rule of some length'; position: absolute; inset: 0 >", k=k)).otherwise("")
    return _suppliers(spark, sf_dir).select("id", F.translate(F.concat(body, more), "<>", "{}").alias("code"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets' ids and signatures, without their texts: written, as the classes read them twice."""
    return written(css_audit.prepared(_sheets(spark, sf_dir)).select("id", "exact", "timeless", "motion", "error"), "sheets")


def css_exact_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css_audit.classes(_signed(spark, sf_dir), "exact")


def css_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css_audit.classes(_signed(spark, sf_dir), "timeless", "exact")


def css_motion_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css_audit.classes(_signed(spark, sf_dir), "motion", "timeless")


def css_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css_audit.candidates(written(css_audit.prepared(_sheets(spark, sf_dir)), "sheets")).select("a_id", "b_id")


def css_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = written(css_audit.prepared(_sheets(spark, sf_dir)), "sheets")
    return css_audit.coverage(good, css_audit.candidates(good))


def _drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing for each supplier k: end point 10 + 0.05 * (k % 4), duration 1, 1.5 or 3 s by k % 3, colour by k % 2. From the twelfth on, k % 5 changes how numbers are written."""
    k = F.col("id")
    y = F.element_at(F.array(*map(F.lit, ("10", "10.05", "10.1", "10.15"))), (k % 4 + 1).cast("int"))
    late = k >= 12  # the first of each kind are written alike
    path = F.when(late & (k % 5 == 1), F.concat(F.lit("M 0.0,0 L 1e1 "), y)).otherwise(F.concat(F.lit("M0 0L10 "), y))
    dur = F.when(late & (k % 5 == 2), F.element_at(F.array(*map(F.lit, ("1000ms", "1500ms", "3000ms"))), (k % 3 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, ("1s", "1.5s", "3.0"))), (k % 3 + 1).cast("int")))
    code = _text(
        '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 100"><path id="p{k}" d="{d}" stroke="{c}" mask="url(#p{k})"><animate attributeName="x" values="{v}" dur="{t}"/></path></svg>',
        k=k, d=path, c=F.when(k % 2 == 0, "red").otherwise("blue"), v=F.when(late & (k % 5 == 0), "0;10").otherwise("0;5;10"), t=dur,
    )
    return _suppliers(spark, sf_dir).select("id", code.alias("code"))


def svg_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return svg_audit.pairs(written(svg_audit.prepared(_drawings(spark, sf_dir)), "drawings"))


def svg_changed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = written(svg_audit.prepared(_drawings(spark, sf_dir)), "drawings")
    moved = svg_audit.pairs(good).where("relation = 'candidate-moved'")
    return svg_audit.changed(moved, good).where("place = 'svg/0/@d' or place like '%/@dur'")


def svg_element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return svg_audit.element_counts(svg_audit.prepared(_drawings(spark, sf_dir)))


def svg_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of a linear course 0, a, b, 30 by thirds, with a and b from the supplier's number."""

    @arrow("string")
    def corners(values: pd.Series) -> pd.Series:
        line = lambda v: svg_audit.trajectory({"attributeName": svg_audit.typed("attributeName", "x", "animate"), "values": svg_audit.typed("values", v, "animate")})
        return values.map(lambda v: ",".join(p[1][0] for p in line(v)))

    values = _text("0;{a};{b};30", a=10 + F.col("id") % 2, b=20 + F.col("id") % 3)
    return _suppliers(spark, sf_dir).select("id", corners(values).alias("corners"))


def css_features_of_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sheet does, by the supplier's number: fades (2), slides (3), blurs (5), reacts (7), shows words (11)."""
    k = F.col("id")
    some = lambda n, yes, no="": F.when(k % n == 0, yes).otherwise(no)
    steps = F.concat(some(2, "opacity: 0; "), some(3, "transform: translateX(4px); "), some(5, "filter: blur(2px); "))
    code = F.concat(F.lit(".a < width: 3px; "), F.lit("animation: m 1s > "), some(11, ".a::after < content: 'word' > "), some(7, ".a:hover < color: red > "), F.lit("@keyframes m < from < top: 0; "), steps, F.lit("> to < top: 0; > > @media (prefers-reduced-motion: reduce) < .a < rotate: 1deg > >"))
    rows = _suppliers(spark, sf_dir).select("id", css_features.css_analysis(F.translate(code, "<>", "{}"), F.lit("animation"), F.lit("")).alias("a"))
    return rows.select("id", "a.asset_type", F.array_join("a.effects", ",").alias("effects"), F.array_join("a.components", ",").alias("components"), F.array_join("a.techniques", ",").alias("techniques"), F.array_join("a.use_cases", ",").alias("use_cases"))


def svg_features_of_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements and animations by the supplier's number."""
    k = F.col("id")
    some = lambda n, yes: F.when(k % n == 0, yes).otherwise("")
    code = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><g/>'), some(2, '<circle r="1"><animate attributeName="r" values="1;2"/></circle>'), some(3, '<rect opacity="0"><animate attributeName="opacity" values="0;1"/></rect>'), some(5, "<text>t</text>"), some(7, "<mask/>"), some(11, "<linearGradient/>"), F.lit("</svg>"))
    rows = _suppliers(spark, sf_dir).select("id", svg_features.svg_analysis(code, F.lit("animation"), F.lit("motion")).alias("a"))
    return rows.select("id", F.array_join("a.effects", ",").alias("effects"), F.array_join("a.components", ",").alias("components"), F.array_join("a.techniques", ",").alias("techniques"))


def _shaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shaders whose names follow from k, whose number from k % 3, and whose last step from k % 2."""
    k = F.col("id")
    code = _text("vec4 transition(vec2 uv) < float v{k} = 0.{n}; float w = v{k} * progress; return mix(getFromColor(uv), getToColor(uv), w{e}); >", k=k, n=k % 3 + 1, e=F.when(k % 2 == 0, " + 0.0").otherwise(""))
    return _suppliers(spark, sf_dir).select("id", F.translate(code, "<>", "{}").alias("code"))


def glsl_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glsl.counted_families(glsl.prepared(_shaders(spark, sf_dir)))


def glsl_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between one shader of each kind; with another number as well, a step more leaves too few runs in common."""
    return glsl.folded_candidates(glsl.prepared(_shaders(spark, sf_dir))).select("a_id", "b_id")


def palettes_with_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measures._palettes(spark, sf_dir, True)
    found = palette.with_gradients(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"))
    return found.where("relation <> 'gradient-candidate-matched'").select("a_id", "b_id", "relation")


def palette_pair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.pair_classes(written(palette.prepared(measures._palettes(spark, sf_dir, True))[0], "palettes"))


def palette_size_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's palette has the first 2 to 4 of four greys that follow from its number's tens."""
    k = F.col("id")
    grey = lambda i: F.concat(F.lit("#"), F.repeat(F.lower(F.lpad(F.hex(F.floor(k / 10) % 50 + 50 * i), 2, "0")), 3))
    rows = _suppliers(spark, sf_dir).select("id", F.slice(F.array(*(grey(i) for i in range(4))), F.lit(1), (k % 3 + 2).cast("int")).alias("colors"), F.lit("s").alias("source"), F.floor(k / 10).cast("string").alias("name"))
    out = palette.size_families(rows)
    return out.select("name", F.array_join("ids", ",").alias("ids"), F.array_join("sizes", ",").alias("sizes"), F.array_join("shared", ",").alias("shared"))


def text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two runs of one letter, the shorter is what they share."""
    k = F.col("id")
    a, b = F.repeat(F.lit("a"), (k % 7 + 1).cast("int")), F.repeat(F.lit("a"), (k % 5 + 1).cast("int"))
    return _suppliers(spark, sf_dir).select("id", F.round(sequence_ratio(F.concat(a, F.lit("b")), F.concat(b, F.lit("c"))), 9).alias("ratio"))


def small_number_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100px against 100 + k % 9 px, with another unit where 4 divides k."""
    k = F.col("id")
    left, right = F.lit("top: 100px; left: 1px"), _text("top: {n}{u}; left: 1px", n=100 + k % 9, u=F.when(k % 4 == 0, "em").otherwise("px"))
    return _suppliers(spark, sf_dir).select("id", css_audit.small_changes(left, right).alias("small"))


@arrow("struct<plain:string,spaced:string,parts:string,said:string,name:string>")
def _css_texts(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
    rows = [(css.without_comments(t, "", True), css.without_comments(t), "|".join(css.split_top(t, ",")), css.literal(t), css.unprefixed(n)) for t, n in zip(texts, names, strict=True)]
    return pd.DataFrame(rows, columns=["plain", "spaced", "parts", "said", "name"])


def css_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, top-level parts, escapes and prefixes of texts with the supplier's number in them."""
    k = F.col("id")
    text = _text("a{k}(b,c)/* {k}, */,[d,e],'f,/*{k}*/\\41 \\'',g", k=k)
    name = F.concat(F.element_at(F.array(*map(F.lit, ("-webkit-", "-moz-", "-ms-", "-o-", ""))), (k % 5 + 1).cast("int")), F.lit("top"))
    rows = _suppliers(spark, sf_dir).select("id", _css_texts(text, name).alias("t"), T.one_space(_text("a  /* {k} */ b 'c  d'", k=k)).alias("one"))
    return rows.select("id", "t.*", "one")


def candidate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier decisions over pairs of nations hold where both digests are what they were."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.sha2("n_name", 256).alias("sha"), "n_regionkey")
    a, b = n.toDF("a_id", "a_sha", "r"), n.toDF("b_id", "b_sha", "q")
    pairs = a.join(b, F.col("r") == F.col("q")).where("a_id < b_id").select(F.lit("css").alias("domain"), "a_id", "b_id", "a_sha", "b_sha")
    old = pairs.where("a_id <> '0'").select("domain", F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), F.col("b_sha").alias("a_sha"), F.when(F.col("b_id") == "7", "changed").otherwise(F.col("a_sha")).alias("b_sha"), F.lit("keep").alias("decision"))
    return exact.decided(pairs, old).select("a_id", "b_id", F.coalesce("decision", F.lit("")).alias("decision"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a domain by section and review, and whether nothing is open."""
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("domain"), F.when(F.col("n_nationkey") % 2 == 0, "family").otherwise("candidate").alias("section"), F.lit(1).alias("n"), (F.col("n_nationkey") % 5 != 1).alias("reviewed"))
    return exact.summary(rows)


def catalog_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All audits over suppliers as sheets (k % 3 = 0), scripts (1) and links (2)."""
    k, none = F.col("id"), F.lit(None)
    code = F.when(k % 3 == 0, F.col("code")).when(k % 3 == 1, F.concat(F.lit("run("), k % 10, F.lit(")")))
    rows = _sheets(spark, sf_dir).select(
        F.lpad(F.col("id").cast("string"), 8, "0").alias("id"), F.when(k % 3 == 2, "reference").otherwise("code").alias("kind"), F.element_at(F.array(*map(F.lit, ("css", "javascript", "link"))), (k % 3 + 1).cast("int")).alias("language"),
        code.alias("code"), none.cast("array<string>").alias("colors"), F.when(k % 3 == 2, F.concat(F.lit("https://example.org/"), k % 20)).alias("sourceUrl"),
    )
    return rechecks.recheck(rows)[1].select("domain", "section", "n", "open")


def domain_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.element_at(F.array(*map(F.lit, vocab.KINDS)), (F.col("p_partkey") % len(vocab.KINDS) + 1).cast("int")).alias("kind"), F.element_at(F.array(*map(F.lit, ("css", "svg", "json"))), (F.col("p_size") % 3 + 1).cast("int")).alias("language"))
    return rows.groupBy(rechecks.domain_of().alias("domain")).agg(F.count(F.lit(1)).alias("n"))


SHEETS = """
with s as (select s_suppkey::bigint as id, s_suppkey % 3 as s, s_suppkey % 4 as w, s_suppkey % 5 = 0 as m, s_suppkey % 7 = 0 as z from supplier),
reps as (select s, w, m, z, min(id) as id from s group by all)
"""
DRAWINGS = """
with s as (select s_suppkey::bigint as id, s_suppkey % 4 as y, s_suppkey % 3 as t, s_suppkey % 2 as c from supplier),
reps as (select y, t, c, min(id) as id from s group by all),
twos as (select a.id as a_id, b.id as b_id, a.y as ay, b.y as "by", a.t as ta, b.t as tb, a.c = b.c as same from reps a join reps b on a.id < b.id),
near as (select a_id, b_id, case when ay <> "by" then 'candidate-moved' when least(ta, tb) = 0 and greatest(ta, tb) = 2 then 'candidate-timing' else 'near' end as relation, * exclude (a_id, b_id) from twos where same),
kin as (select k.a_id, r.id as b_id from reps r join (select y, min(id) as a_id from reps group by y) k on k.y = r.y where r.id <> k.a_id)
"""


def _classes(by: str, differ: str | None = None) -> str:
    kinds = f"count(distinct ({differ}))" if differ else "count(*)"
    return f"{SHEETS} select first_id, id from (select id, min(id) over (partition by {by}) as first_id, ({by}) as k from s) join (select ({by}) as k, {kinds} as n from s group by 1) using (k) where n > 1"


def _listed(marks: dict[str, str], order: tuple[str, ...]) -> str:
    """SQL of the names whose condition holds, in a vocabulary's order."""
    cases = " ".join(f"when '{name}' then {test}" for name, test in marks.items())
    names = ", ".join(f"'{n}'" for n in order if n in marks)
    return f"array_to_string(list_filter([{names}], lambda e: case e {cases} end), ',')"


K = "s_suppkey % {} = 0"
QUERIES = {
    f.__name__: f
    for f in (
        css_exact_classes, css_near_classes, css_motion_families, css_candidates, css_coverage, svg_relations, svg_changed_places, svg_element_counts, svg_courses, css_features_of_sheets, svg_features_of_drawings, glsl_families, glsl_candidates, palettes_with_gradients,
        palette_pair_classes, palette_size_families, text_ratio, small_number_changes, css_text_functions, candidate_decisions, audit_summary, catalog_recheck, domain_routing,
    )
}
NEAR = f"""{measures.BOTH}{measures.NEAR_SQL},
rel as (select a_id, b_id, (s1 + s2) / 2 <= 1 and greatest(s1, s2) <= 2 as near, (t1 + t2) / 2 <= 1 and greatest(t1, t2) <= 2 as back from dist where not same)
"""
ORACLES = {
    "css_exact_classes": _classes("s, w, m, z"),
    "css_near_classes": _classes("w, m, z", "s"),
    "css_motion_families": _classes("m", "w, z"),
    "css_candidates": f"{SHEETS} select a.id as a_id, b.id as b_id from reps a join reps b on a.id < b.id and a.z = b.z and (a.w <> b.w or a.m <> b.m)",
    "css_coverage": f"""{SHEETS} select (select count(*) from s) as sheets, 0::bigint as errors, (select count(*) * (count(*) - 1) // 2 from s) as pairs, (select sum(n * (n - 1) // 2)::bigint from (select count(*) as n from s group by s, w, m, z)) as exact_pairs,
        (select sum(n * (n - 1) // 2)::bigint from (select count(*) as n from s group by w, m, z)) - (select sum(n * (n - 1) // 2)::bigint from (select count(*) as n from s group by s, w, m, z)) as near_pairs,
        (select count(*) from reps a join reps b on a.id < b.id and a.z = b.z and (a.w <> b.w or a.m <> b.m)) as candidates""",
    "svg_relations": f"""{DRAWINGS} select r.id as a_id, s.id as b_id, 'exact' as relation from s join reps r using (y, t, c) where s.id <> r.id union all select a_id, b_id, relation from near
        union all select a_id, b_id, 'family' from kin anti join near using (a_id, b_id)""",
    "svg_changed_places": f"""{DRAWINGS}, m as (select *, ['10', '10.05', '10.1', '10.15'] as e, ['1s', '1.5s', '3s'] as d from near where relation = 'candidate-moved')
        select a_id, b_id, 'svg/0/@d' as place, 'M 0 0 L 10 ' || e[ay + 1] as "left", 'M 0 0 L 10 ' || e["by" + 1] as "right" from m union all select a_id, b_id, 'svg/0/0/@dur', d[ta + 1], d[tb + 1] from m where ta <> tb""",
    "svg_element_counts": "select unnest(['svg', 'path', 'animate']) as tag, (select count(*) from supplier) as n",
    "svg_courses": """select s_suppkey as id, '0' || case when s_suppkey % 2 = 0 and s_suppkey % 3 = 0 then '' else case when 2 * (10 + s_suppkey % 2) <> 20 + s_suppkey % 3 then ',' || (10 + s_suppkey % 2) else '' end
        || case when 2 * (20 + s_suppkey % 3) <> 10 + s_suppkey % 2 + 30 then ',' || (20 + s_suppkey % 3) else '' end end || ',30' as corners from supplier""",
    "css_features_of_sheets": f"""select s_suppkey as id, case when s_suppkey % 7 = 0 then 'interaction' else 'animation' end as asset_type, {_listed({"fade": K.format(2), "slide": "true", "blur": K.format(5)}, vocab.EFFECTS)} as effects,
        {_listed({"text": K.format(11), "shape": "true", "layer": K.format(11), "color": K.format(7)}, vocab.COMPONENTS)} as components, {_listed({"keyframes": "true", "transform": K.format(3), "filter": K.format(5), "pseudo-element": K.format(11)}, vocab.TECHNIQUES)} as techniques,
        {_listed({"intro": "true", "feedback": K.format(7)}, vocab.USE_CASES)} as use_cases from supplier""",
    "svg_features_of_drawings": f"""select s_suppkey as id, {_listed({"scale": K.format(2), "fade": K.format(3)}, vocab.EFFECTS)} as effects, {_listed({"layer": "true", "shape": "s_suppkey % 2 = 0 or s_suppkey % 3 = 0", "text": K.format(5), "mask": K.format(7), "color": K.format(11)}, vocab.COMPONENTS)} as components,
        {_listed({"svg-animation": "s_suppkey % 2 = 0 or s_suppkey % 3 = 0", "clip-path": K.format(7), "gradient": K.format(11)}, vocab.TECHNIQUES)} as techniques from supplier""",
    "glsl_families": "select min(s_suppkey) as first_id, count(*) as members from supplier group by s_suppkey % 2",
    "glsl_candidates": "with r as (select s_suppkey % 2 as e, s_suppkey % 3 as n, min(s_suppkey) as id from supplier group by 1, 2) select a.id as a_id, b.id as b_id from r a join r b on a.id < b.id and a.e <> b.e and a.n = b.n",
    "palettes_with_gradients": f"{NEAR} select a_id, b_id, case when near then 'gradient-near' else 'gradient-candidate-reversed' end as relation from rel where (near or back) and (a_id % 3 = 0 or b_id % 3 = 0)",
    "palette_pair_classes": f"""{NEAR}, n as (select (select count(*) * (count(*) - 1) // 2 from hexes) as every, (select sum(n * (n - 1) // 2) from (select count(*) as n from hexes group by colors)) as exact, (select sum(n * (n - 1) // 2) from (select count(*) as n from hexes group by list_sort(colors))) as any_order,
        (select count(*) from rel where near) as near, (select count(*) from rel where back and not near) as back)
        select unnest(['exact', 'reordered', 'near', 'candidate-reversed', 'candidate-matched', 'subset', 'different']) as relation, unnest([exact::bigint, (any_order - exact)::bigint, near, back, 0, 0, (every - any_order - near - back)::bigint]) as n from n""",
    "palette_size_families": """with p as (select s_suppkey as id, s_suppkey % 3 + 2 as n, s_suppkey // 10 as t from supplier),
        g as (select t, string_agg(id::varchar, ',' order by id) as ids, list_sort(list(distinct n)) as sizes, min(n) as least from p group by t)
        select t::varchar as name, ids, array_to_string(sizes, ',') as sizes, array_to_string(list_sort(list_transform(range(0, least), lambda i: '#' || repeat(lower(printf('%02x', (t % 50 + 50 * i)::int)), 3) || 'ff')), ',') as shared from g where len(sizes) > 1""",
    "text_ratio": "select s_suppkey as id, round(2.0::double * least(s_suppkey % 7 + 1, s_suppkey % 5 + 1) / (s_suppkey % 7 + 1 + s_suppkey % 5 + 1 + 2), 9) as ratio from supplier",
    "small_number_changes": "select s_suppkey as id, s_suppkey % 9 in (1, 2) and s_suppkey % 4 <> 0 as small from supplier",
    "css_text_functions": r"""select s_suppkey as id, 'a' || s_suppkey || '(b,c),[d,e],''f,/*' || s_suppkey || '*/\41 \'''',g' as plain, 'a' || s_suppkey || '(b,c) ,[d,e],''f,/*' || s_suppkey || '*/\41 \'''',g' as spaced,
        'a' || s_suppkey || '(b,c)/* ' || s_suppkey || ', */|[d,e]|''f,/*' || s_suppkey || '*/\41 \''''|g' as parts, 'f,/*' || s_suppkey || '*/A''' as said, 'top' as name, 'a b ''c  d''' as one from supplier""",
    "candidate_decisions": "select a.n_nationkey::varchar as a_id, b.n_nationkey::varchar as b_id, case when a.n_nationkey <> 0 and b.n_nationkey <> 7 then 'keep' else '' end as decision from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey::varchar < b.n_nationkey::varchar",
    "audit_summary": "select 'r' || n_regionkey as domain, count(*) as n, bool_and(n_nationkey % 2 = 0 or n_nationkey % 5 <> 1) as passed from nation group by 1",
    "catalog_recheck": f"""{SHEETS}, c as (select * from s where s = 0), r as (select w, m, z, min(id) as id from c group by all),
        f as (select 'css' as domain, 'exact' as section from c anti join r on c.id = r.id union all select 'css', 'candidate' from r a join r b on a.id < b.id and a.z = b.z
          union all select 'css', 'family' from (select id, min(id) over (partition by m) as first_id from c) where id <> first_id
          union all select 'javascript', 'exact' from (select s_suppkey as id, min(s_suppkey) over (partition by s_suppkey % 10) as f from supplier where s_suppkey % 3 = 1) where id <> f
          union all select 'reference', 'exact' from (select s_suppkey as id, min(s_suppkey) over (partition by s_suppkey % 20) as f from supplier where s_suppkey % 3 = 2) where id <> f)
        select domain, section, count(*) as n, count(*) as open from f group by 1, 2""",
    "domain_routing": f"""select case when k in ('palette', 'reference', 'image') then k when l in ('css', 'svg') then l else 'other' end as domain, count(*) as n
        from (select [{", ".join(repr(x) for x in vocab.KINDS)}][p_partkey % {len(vocab.KINDS)} + 1] as k, ['css', 'svg', 'json'][p_size % 3 + 1] as l from part) group by 1""",
}
