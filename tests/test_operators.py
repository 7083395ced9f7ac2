"""Audits, features, consolidation, admission, shards and the catalog, on small records of our own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import adapters, catalog
from tesserae.operators import admission, analysis, consolidate, dedup, integrity, shards, stats, validate
from tesserae.operators.audits import css as css_audit
from tesserae.operators.audits import exact, glsl, image, palette
from tesserae.operators.audits import svg as svg_audit
from tesserae.operators.features import css as css_features
from tesserae.operators.features import svg as svg_features
from tesserae.operators.search import ArgumentError
from tesserae.sources import scans, sinks


def ids(df):
    return sorted(tuple(r["ids"]) for r in df.collect())


def test_palettes_against_all_pairs(spark):
    rnd = random.Random(3)
    hexed = lambda rgb: "#" + "".join(f"{c:02x}" for c in rgb)
    rows = []
    for i in range(60):
        colours = [[rnd.randrange(256) for _ in range(3)] for _ in range(3)]
        rows.append((f"p{i:03}", [hexed(c) for c in colours]))
        near = [list(c) for c in colours]
        near[0][0] = min(255, near[0][0] + 1)
        rows += [(f"n{i:03}", [hexed(c) for c in near]), (f"r{i:03}", [hexed(c) for c in near[::-1]]), (f"m{i:03}", [hexed(near[k]) for k in (1, 0, 2)])]
    rows += [("bad", ["#12"]), ("long", ["#000"] * 33), ("none", None), ("s", ["#000", "#000000"]), ("t", ["#000000ff", "#000"])]
    good, errors = palette.prepared(spark.createDataFrame(rows, "id string, colors array<string>"))
    assert {r["id"] for r in errors.collect()} == {"bad", "long", "none"} and ids(palette.exact_groups(good)) == [("s", "t")]
    got = {(r["a_id"], r["b_id"]): r["relation"] for r in palette.classified(good).collect()}
    held = {r["id"]: (r["unordered"], np.array(r["vectors"])) for r in good.collect()}
    want = {}
    for a in held:
        for b in held:
            (ua, x), (ub, y) = held[a], held[b]
            if a >= b or len(x) != len(y) or ua == ub:
                continue
            d = lambda p, q: np.maximum(*(np.sqrt(((p - q)[:, i : i + 3] ** 2).sum(1)) for i in (0, 3)))  # noqa: B023, E731
            close = lambda v: v.mean() <= 1 and v.max() <= 2
            from itertools import permutations

            if close(d(x, y)):
                want[a, b] = "near"
            elif close(d(x, y[::-1])):
                want[a, b] = "candidate-reversed"
            elif any(close(d(x, y[list(p)])) for p in permutations(range(len(y)))):
                want[a, b] = "candidate-matched"
    assert got == want and {"near", "candidate-reversed", "candidate-matched"} == set(want.values())


def test_palette_families_and_subsets(spark):
    rows = [("a", ["#111111", "#222222"]), ("b", ["#222222", "#111111"]), ("c", ["#111111", "#111111", "#222222"]), ("d", ["#111111", "#111111"]), ("e", ["#333333", "#222222", "#111111"])]
    good, _ = palette.prepared(spark.createDataFrame(rows, "id string, colors array<string>"))
    assert ids(palette.reordered_families(good)) == [("a", "b")]
    assert sorted(map(tuple, palette.subset_pairs(good).collect())) == [("a", "c"), ("a", "e"), ("b", "c"), ("b", "e"), ("d", "c")]


def sheet(name="m", seconds="1s", middle="0.5", width="10px"):
    return f".{name} {{ width: {width}; animation: {name}-k {seconds} ease infinite }} @keyframes {name}-k {{ from {{ opacity: 0 }} 50% {{ opacity: {middle} }} to {{ opacity: 1 }} }}"


def test_css_audit(spark):
    rows = [("a", sheet()), ("b", sheet("other")), ("c", sheet(seconds="2s")), ("d", sheet(middle="0.505")), ("e", sheet(middle="0.9")), ("f", sheet(width="99px")), ("g", "x {"), ("h", "@keyframes q { 5 { top: 0 } }")]
    good = css_audit.prepared(spark.createDataFrame(rows, "id string, code string"))
    assert {r["id"] for r in good.where("error is not null").collect()} == {"g", "h"}
    assert ids(css_audit.exact_groups(good)) == [("a", "b")] and ids(css_audit.near_groups(good)) == [("a", "b", "c")]
    assert ids(css_audit.families(good)) == [("a", "b", "c", "f")]
    pairs = {(r["a_id"], r["b_id"]) for r in css_audit.candidates(good).collect()}
    assert ("a", "d") in pairs and ("a", "e") not in pairs
    assert [tuple(r) for r in css_audit.coverage(good, css_audit.candidates(good)).collect()] == [(6, 2, 15, 1, 2, 5)]  # a, c, d and f among each other, but a and c
    assert css_audit.tiny_deltas("1px 2px", "1px 2.01px") and not css_audit.tiny_deltas("1px", "1em") and not css_audit.tiny_deltas("1px", "-1px") and not css_audit.tiny_deltas("1px", "1px")


def test_css_signatures_keep_what_matters():
    s = lambda code, **more: dict(zip(css_audit.COLUMNS, css_audit.signature(code, **more), strict=True))
    assert s(".a{-webkit-transform:none}")["exact"] != s(".a{transform:none}")["exact"]
    both = "@keyframes k{from{-webkit-transform:none;transform:none}to{top:0}}"
    assert s(both)["motion"] == s("@keyframes q{from{transform:none}to{top:0}}")["motion"] and s(both)["exact"] != s("@keyframes q{from{transform:none}to{top:0}}")["exact"]
    assert s("@keyframes k{.5%, 0%{top:0}100%{top:1px}}")["error"] is None and s("@keyframes k{50{top:0}}")["error"] == "a keyframe step that is none"
    assert s("@keyframes k{100%{top:1px}0%{top:0}}")["motion"] == s("@keyframes k{0%{top:0}100%{top:1px}}")["motion"]
    assert s(".a{/*")["error"] == "an open comment" and s(".a{content:'x}")["error"] == "an open quote" and s(".a/**/b{top:0}")["exact"] == s(".ab{top:0}")["exact"]
    assert s(".a{color:#FFF}")["exact"] == s(".z{color:#ffffffff}")["exact"] and s(".a{mask:url(#ABC)}")["exact"] != s(".a{mask:url(#abc)}")["exact"]
    assert s(".a{top:0}.a{left:0}")["exact"] != s(".a{top:0;left:0}")["exact"] and s(".a{--x:1px;top:0}")["exact"] == s(".a{top:0}")["exact"]
    assert s(".a{--x:var(--y);--y:1px;top:var(--x)}")["exact"] != s(".a{--x:var(--y);--y:2px;top:var(--x)}")["exact"]
    dom = lambda text, name="a": f'{{"dom":{{"tag":"p","className":"{name}","text":"{text}"}}}}'
    one, other = s(".a{top:0}", preview=dom("x")), s(".a{top:0}", preview=dom("y"))
    assert one["exact"] != other["exact"] and one["shape"] == other["shape"] and one["timeless_text"] == other["timeless_text"]
    assert one["exact"] == s(".b{top:0}", preview=dom("x", "b"))["exact"] and s(".a{top:0}", kind="loader")["shape"] != s(".a{top:0}")["shape"]


def test_css_families_are_more_than_near_copies(spark):
    rows = [("a", sheet()), ("b", sheet("other")), ("c", sheet(seconds="2s")), ("d", sheet("x", middle="0.2")), ("e", sheet("y", middle="0.2", seconds="9s"))]
    good = css_audit.prepared(spark.createDataFrame(rows, "id string, code string"))
    assert css_audit.families(good).collect() == [] and ids(css_audit.near_groups(good)) == [("a", "b", "c"), ("d", "e")]


def drawing(path="M0 0L10 10", values="0;5;10", dur="1s", extra="", ident="p"):
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 100"><path id="{ident}" d="{path}" stroke="url(#{ident})"><animate attributeName="x" values="{values}" dur="{dur}"/></path>{extra}</svg>'


def test_svg_audit(spark):
    rows = {
        "a": drawing(), "b": drawing(path="M 0.0,0 L 10 1e1", ident="q"), "c": drawing(values="0;10"), "d": drawing(dur="1500ms"), "e": drawing(dur="3s"), "f": drawing(path="M0 0L10 10.5"), "g": drawing(path="M0 0L10 30"), "h": drawing(values="0;9;3"),
        "x": drawing(extra="<script/>"), "y": "<svg/>", "z": drawing(extra='<g id="p"/>'), "w": "<!DOCTYPE svg>" + drawing(),
    }
    good = svg_audit.prepared(spark.createDataFrame(list(rows.items()), "id string, code string"))
    assert {r["id"] for r in good.where("error is not null").collect()} == {"w", "x", "z"}  # names without a space are read, but are others
    got = {(r["a_id"], r["b_id"]): r["relation"] for r in svg_audit.pairs(good).collect()}
    assert got["a", "b"] == got["a", "c"] == "exact" and got["a", "d"] == "near" and got["a", "e"] == "candidate-timing" and got["a", "f"] == "candidate-moved" and ("a", "g") not in got and got["a", "h"] == "family"
    assert svg_audit.number("1.50") == "1.5" and svg_audit.number("-0") == "0" and svg_audit.number(".5e1") == "5"
    line = lambda **held: svg_audit.trajectory({k: svg_audit.typed(k, v, "animate") for k, v in held.items()})
    assert line(attributeName="x", values="0;1;2;5") == [["0", ["0"]], ["2/3", ["2"]], ["1", ["5"]]]
    assert line(values="0;1;2;5") is None and line(attributeName="fill", values="0;1") is None and line(attributeName="x", values="0;1", keyTimes="0;.5") is None


def test_svg_relations_of_moved_and_retimed_drawings(spark):
    clocks = lambda a, b: f'<svg xmlns="http://www.w3.org/2000/svg"><path d="M0 0L9 9"/><circle r="3"><animate attributeName="r" values="1;2" dur="{a}"/><animate attributeName="cx" values="1;2" dur="{b}"/></circle></svg>'
    rows = {
        "a": clocks("1s", "10s"), "b": clocks("9s", "10s"), "c": clocks("1s", "11s"), "d": clocks("1s", "10s").replace("9 9", "9 9.1"), "e": clocks("2s", "10s").replace("9 9", "9 9.05"), "f": clocks("1s", "10s").replace("<path", "<style/><path"),
        "g": clocks("1s", "10s").replace('<path d="M0 0L9 9"/>', '<image/>'), "h": clocks("1s", "10s").replace("1;2", "2;1"),
    }
    good = svg_audit.prepared(spark.createDataFrame(list(rows.items()), "id string, code string"))
    assert {r["id"] for r in good.where("error is not null").collect()} == {"f", "g"}
    got = {(r["a_id"], r["b_id"]): r["relation"] for r in svg_audit.pairs(good).collect()}
    assert got["a", "b"] == "candidate-timing" and got["a", "c"] == "near" and got["a", "d"] == "candidate-moved" and got["a", "e"] == "candidate-moved" and got["a", "h"] == "family"
    pair = spark.createDataFrame([("a", "d")], "a_id string, b_id string")
    assert [tuple(r) for r in svg_audit.changed(pair, good).collect()] == [("a", "d", "svg/0/@d", "M 0 0 L 9 9", "M 0 0 L 9 9.1")]
    assert {r["tag"]: r["n"] for r in svg_audit.element_counts(good).collect()} == {"svg": 6, "path": 6, "circle": 6, "animate": 12}
    assert svg_audit.differences({"x": 1, "y": 2}, {"y": 3, "z": 4}) == [("x", 1, None), ("y", 2, 3), ("z", None, 4)]


SHADER = "uniform float size; // = 0.3\nvec4 transition(vec2 uv) {{ float {v} = {n}; return mix(getFromColor(uv), getToColor(uv), {v} * progress); }}"


def test_glsl_audit(spark):
    rows = [("a", SHADER.format(v="x", n="0.5")), ("b", SHADER.format(v="yy", n="0.5") + " // note"), ("c", SHADER.format(v="x", n="0.7")), ("d", SHADER.format(v="x", n="0.5 + 1.0")), ("e", "void main() {}"), ("f", "")]
    good = glsl.prepared(spark.createDataFrame(rows, "id string, code string"))
    assert ids(glsl.exact_groups(good)) == [("a", "b")] and ids(glsl.families(good)) == [("a", "b", "c")]
    assert {(r["a_id"], r["b_id"]) for r in glsl.candidates(good).collect()} == {("a", "d"), ("b", "d"), ("c", "d")}


def test_image_audit(spark):
    rng = np.random.default_rng(0)
    smooth = lambda: np.kron(rng.random((16, 16)), np.ones((8, 8)))
    a, b = smooth(), smooth()
    planes = {"a": a, "b": np.rot90(np.roll(a, 24, axis=0)), "c": a * 0.5 + 0.1, "d": b, "e": a + rng.normal(0, 0.01, a.shape), "flat": np.full((128, 128), 0.5)}
    assert image.structure(a, planes["b"]) == pytest.approx(1) and image.structure(a, b) < 0.9 and image.structure(a, planes["flat"]) is None
    rows = [(k, "same" if k in "ad" and False else k, bytearray(p.astype("<f4").tobytes())) for k, p in planes.items()] + [("a2", "a", bytearray(a.astype("<f4").tobytes()))]
    got = {(r["a_id"], r["b_id"]): r["relation"] for r in image.audit(spark.createDataFrame(rows, "id string, sha256 string, plane binary")).collect()}
    assert got["a", "a2"] == "exact" and got["a", "e"] == "near" and got.get(("a", "d")) != "near"


def test_references_and_decisions(spark):
    rows = [("a", "https://X.org/p", None), ("b", "HTTPS://x.org/p", None), ("c", "https://x.org/p", "2"), ("d", "https://x.org/P", None)]
    same, family = exact.references(spark.createDataFrame(rows, "id string, sourceUrl string, sourceCardId string"))
    assert ids(same) == [("a", "b")] and ids(family) == [("a", "b", "c")]
    kind = "domain string, a_id string, b_id string, a_sha string, b_sha string"
    pairs = spark.createDataFrame([("css", "a", "b", "1", "2"), ("css", "a", "c", "1", "3")], kind)
    old = spark.createDataFrame([("css", "b", "a", "2", "1", "keep"), ("css", "a", "c", "1", "9", "merge")], kind + ", decision string")
    assert {r["b_id"]: r["decision"] for r in exact.decided(pairs, old).collect()} == {"b": "keep", "c": None}
    found = spark.createDataFrame([("css", "exact", 0, False), ("css", "candidate", 2, True), ("svg", "near", 1, True)], "domain string, section string, n int, reviewed boolean")
    assert {r["domain"]: r["passed"] for r in exact.summary(found).collect()} == {"css": True, "svg": False}


def test_css_features():
    kind, effects, parts, properties, techniques, uses, signals, valid = css_features.analyse(sheet(), "loader")
    assert (kind, effects, techniques, uses, valid) == ("loader", ["fade"], ["keyframes"], ["intro", "status"], True)
    assert "opacity" in properties and parts == ["shape"] and any(s.startswith("@keyframes:m-k") for s in signals)
    shaking = "@keyframes s { 0% {transform: translateX(-5px)} 25% {transform: translateX(5px)} 50% {transform: translateX(-4px)} 100% {transform: translateX(2px)} } .a::before {content: '»'; animation: s 1s cubic-bezier(0,2,1,1)}"
    got = css_features.analyse(shaking)
    assert got[1] == ["slide", "spring", "shake"] and got[2] == ["shape", "layer"] and "pseudo-element" in got[4]
    assert css_features.analyse("@media (prefers-reduced-motion) { @keyframes q { from { opacity: 0 } } }")[1] == []
    assert css_features.analyse(".a { content: 'rotate(90deg)' } .a:hover { color: red }")[0] == "interaction"
    assert css_features.analyse(".a { x")[-1] is False


def test_svg_features():
    got = svg_features.analyse(drawing(), "loader")
    assert got[1] == ["slide"] and got[2] == ["shape", "stroke"] and got[5] == ["status"]
    assert svg_features.analyse("<!DOCTYPE svg>" + drawing()) is None and svg_features.analyse("<a/>") is None
    still = '<svg><g><circle r="1"/></g><mask/><linearGradient/></svg>'
    assert svg_features.analyse(still, "shape", "design")[4:6] == (["clip-path", "gradient", "svg-geometry", "static-design"], ["design-kit"])


ITEM = {"id": "x", "title": "T", "description": "some words", "category": "animation", "kind": "code", "domain": None, "tags": ["t"], "sourceUrl": "https://example.org/x", "sourceName": "Example", "license": "MIT", "licenseUrl": None, "licenseText": None, "verifiedAt": "2026-10-08", "verification": "yes", "preview": ("css", "v", None, None), "code": sheet(), "colors": None, "language": "css", "access": "public", "image": None}


def records(spark, *changes):
    rows = [tuple((ITEM | {"id": f"i{n}", "sourceUrl": f"https://example.org/{n}"} | c).values()) for n, c in enumerate(changes)]
    df = spark.createDataFrame(rows, validate.ITEM)
    order = {(ITEM | {"id": f"i{n}"} | c)["id"]: n for n, c in enumerate(changes)}
    return df.withColumn("row_order", F.coalesce(*(F.when(F.col("id") == k, F.lit(v)) for k, v in order.items()), F.lit(0)).cast("long"))


def test_validation(spark):
    bad = [{"id": "-x"}, {"title": " "}, {"category": "none"}, {"access": "private"}, {"tags": ["x" * 121]}, {"colors": ["red"]}, {"sourceUrl": "ftp://a"}, {"kind": "reference"}, {"language": "c"}, {"verification": None}, {"kind": "image"}]
    good, errors = validate.validated(records(spark, {}, *bad))
    assert [r["id"] for r in good.collect()] == ["i0"] and errors.count() == len(bad)
    with pytest.raises(validate.RecordError):
        validate.validated(records(spark, *bad), strict=True)


def test_dedup_and_merge(spark):
    rows = records(spark, {"title": "Same", "sourceUrl": "https://a.org/p"}, {"title": "SAME", "sourceUrl": "https://a.org/p/?utm_x=1"}, {"title": "Other"})
    assert sorted(r["id"] for r in dedup.deduplicate(rows).collect()) == ["i0", "i2"]
    made = "id string, fingerprint string, input_order int, row_order int, input_name string"
    old = spark.createDataFrame([("o", "f1", 0, 0, "base")], made)
    new = spark.createDataFrame([("a", "f1", 1, 0, "w1"), ("b", "f2", 1, 1, "w1"), ("c", "f2", 2, 0, "w2"), ("d", None, 2, 1, "w2"), ("e", None, 2, 2, "w2")], made)
    kept, out, counts = dedup.merge(old, new)
    assert sorted(r["id"] for r in kept.collect()) == ["b", "d", "e"] and sorted((r["id"], r["same_as"]) for r in out.collect()) == [("a", "o"), ("c", "b")]
    assert {r["input_name"]: (r["received"], r["accepted"], r["excluded"]) for r in counts.collect()} == {"w1": (2, 1, 1), "w2": (3, 2, 1)}


def test_fingerprints(spark):
    rows = [("code", "css", "a  { /* x */ b:'c  d' }", None, None), ("code", "css", "a { b:'c  d' }", None, None), ("code", "svg", '<svg b="1" a="2"> <g/> </svg>', None, None), ("code", "svg", '<svg a="2" b="1"><g/></svg>', None, None), ("palette", None, None, ["#ABC", "#112233"], None), ("palette", None, None, ["#aabbcc", "#112233"], None), ("reference", None, None, None, None), ("image", None, None, None, "0" * 64), ("code", "glsl", " ", None, None)]
    df = spark.createDataFrame(rows, "kind string, language string, code string, colors array<string>, sha string")
    got = [r["f"] for r in df.select(dedup.fingerprint(*(F.col(c) for c in df.columns)).alias("f")).collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[4] == got[5] and got[6] is None and got[7] == ("image", "0" * 64) and got[8] is None


def test_consolidation_fails_closed(spark):
    items = spark.createDataFrame([("a", 0, "code", "1", "r1"), ("b", 1, "code", "2", "r2"), ("c", 2, "code", "3", "r3"), ("p", 3, "palette", "4", "r4")], "id string, pos int, kind string, code_sha string, record_sha string")
    kind = "group string, member string, mode string, code_sha string, record_sha string"
    policy = lambda *rows: spark.createDataFrame(rows, kind)
    good = policy(("a", "a", "motion", "1", "r1"), ("a", "c", "motion", "3", "r3"))
    parents, aliases = consolidate.apply(items, good)
    assert sorted(r["id"] for r in parents.collect()) == ["a", "b", "p"] and [tuple(r) for r in aliases.collect()] == [("c", "a")]
    assert sorted(map(tuple, consolidate.originals(parents).collect())) == [("a", "a"), ("b", "b"), ("c", "a"), ("p", "p")]
    for bad in (policy(("a", "a", "motion", "1", "r1")), policy(("a", "a", "motion", "9", "r1"), ("a", "b", "motion", "2", "r2")), policy(("b", "a", "motion", "1", "r1"), ("b", "b", "motion", "2", "r2")), policy(("a", "a", "motion", "1", "r1"), ("a", "p", "motion", "4", "r4")), policy(("a", "a", "zzz", "1", "r1"), ("a", "b", "zzz", "2", "r2")), policy(("a", "a", "motion", "1", "r1"), ("a", "x", "motion", "2", "r2"))):
        with pytest.raises(consolidate.PolicyError):
            consolidate.apply(items, bad)


def plain_admission(times, most, seconds):
    held, out = [], []
    for t in times:
        held = [x for x in held if t - x < seconds]
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out


def test_admission(spark):
    rnd = random.Random(1)
    times = sorted(rnd.randrange(400) for _ in range(120)) + [1000, 1060]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "user_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = [r["admitted"] for r in admission.admitted(df, most=7).orderBy("event_id").collect()]
    assert got == plain_admission(times, 7, 60)
    clock = iter(times)
    limiter = adapters.Limiter(7, 60, lambda: next(clock))
    assert [limiter.admit("c") for _ in times] == got


def test_shards(spark):
    assert shards.greedy([1] * 65)[0] == [0] * 64 + [1] and shards.greedy([270_000] * 2)[0] == [0, 1]
    with pytest.raises(ValueError):
        shards.greedy([600_000])
    rows = spark.createDataFrame([(i * 3, (i * 7919) % 90_000, f"b{i}") for i in range(9_000)], "doc_id long, size long, body string").repartition(7)
    got = {r["doc_id"]: r["shard"] for r in shards.assigned(rows, "doc_id", "size").collect()}
    want = shards.greedy([(i * 7919) % 90_000 for i in range(9_000)])[0]
    assert [got[i * 3] for i in range(9_000)] == want
    names = shards.manifest(rows, shards.assigned(rows, "doc_id", "size"), "doc_id", "body")
    assert names.agg(F.sum("items")).head()[0] == 9_000 and names.select("name").distinct().count() == names.count()


def test_stats(spark):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("a", None), (None, ["x"])], "k string, v array<string>")
    assert sorted(map(tuple, stats.facet_counts(rows, {"k": F.col("k")}, {"v": F.col("v")}).collect())) == [("k", "a", 2), ("v", "x", 2), ("v", "y", 1)]
    assert [r["share"] for r in stats.shares(rows.limit(0).select(F.lit("z").alias("z"), F.lit(1).alias("n")), "n", ["z"]).collect()] == []
    a, b = rows.select("k"), rows.select("k").limit(2)
    assert integrity.differences(a, b).count() == 1
    pins = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, sha string")
    assert integrity.pinned(pins.limit(1), pins, "id", "sha").count() == 1


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("catalog"))
    base = records(
        spark, {"title": "한국어 Fade", "tags": ["fade", "soft"]}, {"title": "áccent Spin", "code": sheet("q", "2s")}, {"title": "Palette", "kind": "palette", "category": "palette", "language": "json", "code": '["#112233","#abc"]', "colors": ["#112233", "#abc"]},
        {"title": "Link", "kind": "reference", "category": "reference", "language": "link", "code": None, "license": "Unknown"}, {"title": "Shader", "category": "transition", "language": "glsl", "code": SHADER.format(v="x", n="0.5")}, {"title": "Drawing", "category": "shape", "language": "svg", "code": drawing(), "preview": ("svg", "v", None, None)},
    )
    wave = records(spark, {"id": "w0", "code": sheet() + " "}, {"id": "w1", "code": sheet("new", "9s", "0.1"), "sourceUrl": "https://example.org/0", "title": "한국어 Fade"})
    plain = catalog.build([("base", base)], [("wave", wave)])
    rows = {r["id"]: r for r in plain["items"].collect()}
    policy = spark.createDataFrame([("i0", m, "motion", rows[m]["code_sha"], rows[m]["record_sha"]) for m in ("i0", "i1")], "group string, member string, mode string, code_sha string, record_sha string")
    parts = catalog.build([("base", base)], [("wave", wave)], policy)
    catalog.publish(parts, path, "v1")
    return path


def test_catalog(spark, bundle):
    c = catalog.Catalog(spark, bundle)
    found = c.search(query="fade", limit=1)
    assert found["total"] == 3 and len(found["items"]) == 1  # two titles, and a shader that fades
    assert [i["id"] for i in c.search(query="accent")["items"]] == ["i0"]  # a variant's title
    assert c.search(query="한국")["total"] == 2 and c.search(query="...")["total"] == 0 and c.search(query="x'; drop table")["total"] == 0
    assert c.search(kind="palette")["items"][0]["id"] == "i2" and c.search(effect="fade")["total"] >= 2 and c.search(license="a'b")["total"] == 0
    assert [i["id"] for i in c.search(limit=2, offset=1)["items"]] == [i["id"] for i in c.search()["items"]][1:3]
    assert c.get("i1")["canonical_id"] == "i0" and c.get("i1")["variant_role"] == "motion-variant" and c.get("i0")["id"] == "i0" and c.get("none") is None
    s = c.stats()
    assert s["total"] == 6 and s["stored"] == 5 and s["kind"] == {"code": 4, "palette": 1, "reference": 1} and s["sources"] == 6  # the provider of a variant, too
    assert [r["id"] for r in c.export().collect()] == sorted(r["id"] for r in c.export().collect())
    assert {r["check"]: r["faults"] for r in c.verify().collect() if r["faults"]} == {}
    assert [tuple(r) for r in c.part("excluded").select("id", "same_as").collect()] == [("w0", "i0")]
    with pytest.raises(scans.Unavailable):
        catalog.Catalog(spark, bundle + "-none")


def test_analysis_of_records(spark, bundle):
    rows = {r["id"]: r for r in catalog.Catalog(spark, bundle).part("items").collect()}
    assert (rows["i2"]["asset_type"], rows["i2"]["basis"], rows["i2"]["domain"]) == ("palette", "color-values", "design")
    assert (rows["i3"]["asset_type"], rows["i3"]["domain"], rows["i3"]["use_cases"]) == ("reference", None, ["reference"])
    assert rows["i4"]["effects"] == ["fade"] and "glsl" in rows["i4"]["techniques"] and rows["i5"]["basis"] == "code" and rows["i5"]["domain"] == "motion"
    changed = spark.createDataFrame([("i0", "x", ["wave"]), ("zz", "x", ["wave"])], "id string, sourceSha256 string, effects array<string>")
    items = spark.createDataFrame([("i0", "x", ["fade"]), ("i1", "y", ["fade"])], "id string, record_sha string, effects array<string>")
    out, errors = analysis.reviewed(items, changed)
    assert {r["id"]: r["effects"] for r in out.collect()} == {"i0": ["wave"], "i1": ["fade"]} and [tuple(r) for r in errors.collect()] == [("zz", "no such record")]


def test_transports(spark, bundle):
    import io
    import json

    c = catalog.Catalog(spark, bundle)
    assert adapters.answer(c, "/api/search?query=fade&limit=1")[0] == 200 and adapters.answer(c, "/api/search?limit=x")[0] == 400 and adapters.answer(c, "/api/search?limit=1&limit=2")[0] == 400
    assert adapters.answer(c, "/api/items/i1")[0] == 200 and adapters.answer(c, "/api/items/none")[0] == 404 and adapters.answer(c, "/x")[0] == 404 and adapters.answer(c, "/" + "x" * 9000)[0] == 414
    call = lambda **k: json.dumps({"jsonrpc": "2.0"} | k).encode() + b"\n"
    lines = [b"no\n", call(id=1, method="tools/list"), call(id=2, method="initialize"), call(method="notifications/initialized"), call(id=3, method="tools/list"), call(id=4, method="tools/call", params={"name": "get", "arguments": {"id": "i0"}}), call(id=5, method="tools/call", params={"name": "search", "arguments": {"limit": 0}}), b'{"a":1,"a":2}\n', b"x" * 300_000 + b"\n", call(id=6, method="ping"), call(id=7, method="zz")]
    sink = io.BytesIO()
    adapters.rpc(c, io.BytesIO(b"".join(lines)), sink)
    out = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [o.get("error", {}).get("code") for o in out] == [-32700, -32002, None, None, None, None, -32700, -32600, None, -32601]
    assert out[5]["result"]["isError"] and "i0" in out[4]["result"]["content"][0]["text"]
    from tesserae.__main__ import main

    assert main([bundle, "get", "i0"], spark) == 0 and main([bundle, "get", "none"], spark) == 1 and main([bundle, "search", "--limit", "0"], spark) == 2
    with pytest.raises(ArgumentError):
        adapters.arguments_of([("limit", "١")])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.json").write_text('﻿[{"id":"a","n":1},{"id":"b","n":2}]', encoding="utf-8")
    rows = scans.json_rows(spark, str(tmp_path / "in.json"), "id string, n int").collect()
    assert [(r["id"], r["n"], r["row_order"]) for r in rows] == [("a", 1, 0), ("b", 2, 1)]
    assert scans.json_rows(spark, str(tmp_path / "none.json"), "id string").collect() == []
    for text, most in (('{"id":"a"}', 99), ('[{"id":"a"}]', 3)):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception, match="array|large"):
            scans.json_rows(spark, str(tmp_path / "bad.json"), "id string", most).collect()
    sinks.write_json(str(tmp_path / "out" / "x.json"), {"a": "é"})
    assert (tmp_path / "out" / "x.json").read_text() == '{"a":"é"}'
    items = spark.createDataFrame([("b", "=1+1", "animation", ["t"]), ("a", "fine", "palette", [])], "id string, title string, category string, tags array<string>")
    cells = sinks.export_cells(items).collect()
    assert [(r["id"], r["title"], r["tags"]) for r in cells] == [("a", "fine", "[]"), ("b", "'=1+1", '["t"]')]
    sinks.write_csv(items, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert {r["title"] for r in back} == {"fine", "'=1+1"}
    aliases = spark.createDataFrame([("y", "b"), ("x", 'a"')], "alias string, item_id string")
    sinks.write_aliases(aliases, str(tmp_path / "aliases.json"), "2026-01-01")
    assert (tmp_path / "aliases.json").read_text() == '{"version":1,"updatedAt":"2026-01-01","aliases":{"x":"a\\"","y":"b"}}'
    pins = spark.createDataFrame([("x.json", "0"), ("none", "0")], "name string, sha256 string")
    assert {r["name"]: r["error"] for r in scans.pinned_files(spark, str(tmp_path / "out"), pins).collect()} == {"x.json": "another digest", "none": "no file"}
    assert "animation: 2" in sinks.digest_text({"total": 2, "category": {"animation": 2}})


def streamed(spark, df, name, folder):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def test_streams(spark, tmp_path):
    from tesserae.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(f'{{"id":"{i}","code":"c{i % 3}","at":"2026-01-01T00:00:{i:02d}Z","user":"u"}}' for i in range(9)))
    rows = ingest.records(spark, str(folder), "id string, code string, at timestamp, user string")
    assert streamed(spark, ingest.first_wins(rows, "at"), "unique", tmp_path / "unique").count() == 3


def test_rate_limit_stream_is_the_batch_form(spark, tmp_path):
    """Calls come out of order, over several triggers, with ties, a call without a time and users without a name."""
    import json
    import os
    import random

    from tesserae.operators import admission
    from tesserae.streaming import ingest

    random.seed(3)
    at = lambda s: f"2026-01-01T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z"
    calls = sorted((s + random.randint(-40, 0), i, random.choice(["a", "a", "a", "b", None])) for i, s in enumerate(random.choices(range(60, 900), k=300)))
    calls = sorted(calls, key=lambda c: c[0] + random.randint(0, 40))
    rows = [{"n": i, "user": u, "at": at(s)} for s, i, u in calls] + [{"n": 900, "user": "a", "at": None}]
    rows += [{"n": 901, "user": "z", "at": at(6000)}]  # what the watermark needs to pass all before
    folder = tmp_path / "calls"
    folder.mkdir()
    for k in range(0, len(rows), 60):
        file = folder / f"{k:04d}.json"
        file.write_text("\n".join(map(json.dumps, rows[k : k + 60])))
        os.utime(file, (k + 1_000_000, k + 1_000_000))
    kind = "n long, user string, at timestamp"
    got = streamed(spark, ingest.admitted(ingest.records(spark, str(folder), kind, files=1), "user", "at", "n", most=4, seconds=60, delay="2 minutes"), "limited", tmp_path / "state")
    want = admission.admitted(spark.read.schema(kind).json(str(folder)), "user", "at", "n", most=4, seconds=60)
    got, want = {r["n"]: r["admitted"] for r in got.collect()}, {r["n"]: r["admitted"] for r in want.collect()}
    assert want.pop(901) and got == want and 0 < sum(got.values()) < 300 and got[900] is False
