"""Source reviews, preview trees, the recheck's guard, session cuts and the tree of shard blocks."""

import copy
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import admission, dom, recheck, reviews, shards, source_reviews
from tesserae.operators.audits import glsl

ORIGINAL = "// head\r\nfunction move(m, t) {\r\n  m.x = t;\r\n}\r\n// end\r\n"
CODE = "".join(ORIGINAL.splitlines(keepends=True)[1:4])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ITEM = {
    "id": "move", "kind": "code", "language": "javascript", "domain": "motion", "code": CODE, "licenseText": "MIT\nwhole", "preview": {"type": "reference"},
    "collectionEvidence": {"version": 1, "original": {"path": "data/upstream/expansion12-film/engine.js", "sha256": sha(ORIGINAL)}, "notice": {"path": "data/upstream/expansion12-film/LICENSE", "sha256": "1" * 64}, "storedSha256": sha(CODE)},
}
REVIEW = {
    "version": 1, "sourceSha256": sha(CODE), "revision": "a" * 40, "sourceRange": {"startLine": 2, "endLine": 4},
    "classification": {"domain": "motion", "assetType": "animation", "effects": ["slide"], "components": ["shape"], "useCases": ["intro"], "techniques": ["transform"]},
    "evidence": {"basis": "reviewed-source", "confidence": "high", "summaryKO": "요약", "summaryEN": "moves", "signals": ["m.x = t"]}, "dependencies": ["a scene"], "limitations": ["no loop"],
    "preview": {"mode": "illustration", "language": "svg", "code": "<svg><circle r='5'/></svg>", "license": "CC0-1.0", "notice": "own", "attribution": "us", "limitations": ["drawn"]},
}


def changed(value, path, new):
    out = copy.deepcopy(value)
    *steps, last = path.split(".")
    at = out
    for s in steps:
        at = at[s]
    if new is ...:
        del at[last]
    else:
        at[last] = new
    return out


@pytest.mark.parametrize(
    ("path", "new", "fault"),
    [
        ("language", "css", "kind"), ("kind", "reference", "kind"), ("referenceReview", {}, "two reviews"), ("id", "-x", "id"), ("licenseText", " ", "licenseText"), ("licenseText", "x" * 120_001, "licenseText"), ("licenseText", "\U0001f600" * 60_001, "licenseText"),
        ("preview", {"type": "css"}, "preview type"), ("domain", "design", "classification"), ("collectionEvidence.version", True, "receipt"), ("collectionEvidence.original.path", "data/upstream/expansion12-film/../x.js", "receipt"),
        ("collectionEvidence.original.path", "C:/x.js", "receipt"), ("collectionEvidence.original.sha256", "x" * 64, "receipt"), ("collectionEvidence.storedSha256", "0" * 64, "receipt"), ("collectionEvidence", ..., "receipt"),
    ],
)
def test_rules_of_a_record(path, new, fault):
    assert source_reviews.faults(json.dumps(changed(ITEM, path, new)), json.dumps(REVIEW)) == [fault]


@pytest.mark.parametrize(
    ("path", "new", "faults"),
    [
        ("version", True, ["version"]), ("revision", "main", ["revision"]), ("extra", 1, ["fields"]), ("sourceSha256", "0" * 64, ["stale"]), ("sourceSha256", "zz", ["sourceSha256", "stale"]), ("sourceRange.startLine", True, ["sourceRange"]), ("sourceRange.endLine", 100_001, ["sourceRange"]),
        ("sourceRange.startLine", 5, ["sourceRange"]), ("classification.domain", "tooling", ["classification"]), ("classification.effects", ["x"], ["classification"]), ("classification.techniques", ["eval"], ["classification"]), ("classification.assetType", "reference", ["classification"]),
        ("evidence.basis", "code", ["evidence"]), ("evidence.confidence", "low", ["evidence"]), ("evidence.signals", [], ["evidence"]), ("dependencies", [str(i) for i in range(33)], ["dependencies"]), ("dependencies", ["a", "a"], ["dependencies"]), ("limitations", [], ["limitations"]),
        ("preview.limitations", [], ["illustration"]), ("preview.mode", "source", ["illustration"]), ("preview.license", "MIT", ["illustration"]), ("preview.code", "<svg><script/></svg>", ["illustration"]), ("preview.dom", {"tag": "p"}, ["illustration"]),
        ("preview", {**REVIEW["preview"], "language": "css", "code": ".a{opacity:1}", "dom": {"tag": "script"}}, ["illustration"]), ("preview", {**REVIEW["preview"], "language": "css", "code": ".a{opacity:1}", "dom": {"tag": "p"}}, []),
    ],
)
def test_rules_of_a_review(path, new, faults):
    assert source_reviews.faults(json.dumps(ITEM), json.dumps(changed(REVIEW, path, new))) == faults


def test_text_is_bounded_as_a_browser_counts():
    assert source_reviews.shown("\U0001f600" * 5, 10) and not source_reviews.shown("\U0001f600" * 6, 11) and not source_reviews.shown("\ud800", 9) and not source_reviews.shown("a\x07", 9)
    assert source_reviews.faults("no", "{}") == ["json"] and source_reviews.faults("[]", "{}") == ["json"] and source_reviews.faults(json.dumps(ITEM), json.dumps(REVIEW)) == []


SCHEMA = "id string, kind string, language string, domain string, code string, licenseText string, preview struct<type:string>, collectionEvidence struct<version:int,original:struct<path:string,sha256:string>,notice:struct<path:string,sha256:string>,storedSha256:string>, sourceReview string"


def stored(spark, *rows):
    return spark.createDataFrame([{**ITEM, **r} for r in rows], SCHEMA)


def test_lines_of_the_original(spark, tmp_path):
    home = tmp_path / "data/upstream/expansion12-film"
    home.mkdir(parents=True)
    (home / "engine.js").write_bytes(ORIGINAL.encode())
    good, short = json.dumps(REVIEW), json.dumps(changed(REVIEW, "sourceRange.startLine", 1))
    gone = changed(ITEM, "collectionEvidence.original.path", "data/upstream/expansion12-film/none.js")["collectionEvidence"]
    other = changed(ITEM, "collectionEvidence.original.sha256", "0" * 64)["collectionEvidence"]
    rows = stored(spark, {"sourceReview": good}, {"id": "lf", "code": CODE.replace("\r\n", "\n"), "sourceReview": good}, {"id": "range", "sourceReview": short}, {"id": "gone", "collectionEvidence": gone, "sourceReview": good}, {"id": "sha", "collectionEvidence": other, "sourceReview": good}, {"id": "none"})
    assert sorted(map(tuple, source_reviews.originals_differ(rows, str(tmp_path)).collect())) == [("gone", "no original"), ("lf", "other lines"), ("range", "other lines"), ("sha", "another digest")]
    assert {r["id"]: r["faults"] for r in source_reviews.checked(rows).collect()} == {"move": [], "lf": ["stale", "receipt"], "range": [], "gone": [], "sha": []}
    assert [r["id"] for r in source_reviews.unreviewed(rows).collect()] == ["none"]


def test_a_review_goes_before_all_other_analysis(spark):
    made = source_reviews.analysis(stored(spark, {"sourceReview": json.dumps(REVIEW)})).head()
    assert (made["domain"], made["asset_type"], made["effects"], made["basis"], made["confidence"], made["properties"]) == ("motion", "animation", ["slide"], "reviewed-source", "high", [])
    assert made["signals"] == ["m.x = t", "stored-source-code-sha256:" + sha(CODE), "upstream-revision:" + "a" * 40, "original-javascript-execution:disabled", "source-dependency:a scene", "source-limitation:no loop"]
    said = stored(spark, {"sourceReview": json.dumps(REVIEW)}).select(source_reviews.limitations(F.col("sourceReview")).alias("x")).head()["x"]
    assert said == [*source_reviews.LIMITATIONS, "no loop", "drawn"]


def plain_tree(node, bounds, depth=0, left=None):
    """Whether a tree is sound, by recursion."""
    left = left if left is not None else [bounds.nodes]
    if not isinstance(node, dict) or depth > bounds.depth or left[0] < 1 or set(node) - set(dom.KEYS) or not all(dom.KEYS[k](v, bounds) for k, v in node.items()):
        return False
    left[0] -= 1
    return all(plain_tree(c, bounds, depth + 1, left) for c in node.get("children", []))


def test_trees_equal_a_recursive_rule():
    r = random.Random(2)

    def tree(depth):
        node = {"tag": r.choice(["div", "p", "h1", "input"] * 12 + ["script", 3])}
        if r.random() < 0.3:
            node["className"] = r.choice(["a b", "a  b-c", "_x", "é"] * 6 + ["1a", "a b ", "a" * 181])
        if r.random() < 0.3:
            node["text"] = "x" * r.choice([0, 64] * 9 + [65])
        if r.random() < 0.2:
            node["variables"] = r.choice([{"--a": "1px"}] * 9 + [{"a": "1"}, {"--a": "url (x)"}, {"--a": "é"}, {"--a": ""}])
        if r.random() < 0.02:
            node["onclick"] = "x"
        if depth and r.random() < 0.8:
            node["children"] = [tree(depth - 1) for _ in range(r.choice([0, 1, 2, 3, 5]))]
        return node

    seen = set()
    for _ in range(3000):
        t = tree(r.choice([0, 2, 4, 5, 6]))
        for bounds in (dom.PREVIEW, dom.ILLUSTRATION):
            fault = dom.first_fault(t, bounds)
            assert (fault is None) == plain_tree(t, bounds)
            seen.add((fault or ":").rsplit(":", 1)[1])
    assert seen >= {"", "tag", "className", "text", "variables", "key", "depth"}


def test_faults_are_named_in_document_order():
    p = {"tag": "p"}
    assert dom.walked({"children": [p, {"children": [p, {"tag": "script"}, {"x": 1}]}]}) == (5, "1.1:tag")
    assert dom.first_fault({"children": [p] * 33}, dom.ILLUSTRATION) == ":children" and dom.first_fault({"children": [p] * 33}) is None
    assert dom.first_fault({"children": [{"children": [p] * 31}] * 3}, dom.ILLUSTRATION) == "1.30:nodes" and dom.first_fault([]) == ":node" and dom.first_fault({"className": None}) == ":className"
    assert reviews.dom_nodes({"tag": "script"}) == 0 and reviews.dom_nodes({"tag": "div", "onclick": "x"}) == 0 and reviews.dom_nodes({"children": [p] * 40}) == 41


def test_artifacts_have_links_to_hosts_and_lie_below_a_root():
    link = lambda u: reviews._artifact({"path": "a/b", "sha256": "1" * 64, "sourceUrl": u})
    assert link("https://a.org/x") and not any(map(link, ("ftp://a.org", "https://u:p@a.org", "https:///x", "x", 5, "http://[a")))
    review = json.dumps({"evidence": {"artifacts": [{"path": "data/upstream/a"}, {"path": "data/other/a"}]}})
    assert reviews.outside(review, "data/upstream") == ["data/other/a"] and reviews.outside("no", "x") == []


def test_the_digest_has_no_order_and_a_moving_catalog_is_refused(spark):
    rows = [("a", "code", "css", ".a{top:0}", ["#fff"], "https://a.org"), ("b", "code", "css", ".b{top:1px}", [], "https://b.org"), ("c", "reference", "link", None, [], "https://c.org")]
    items = spark.createDataFrame(rows, "id string, kind string, language string, code string, colors array<string>, sourceUrl string")
    whole = recheck.digest(items)
    assert whole == recheck.digest(items.orderBy(F.desc("id")).repartition(3)) and whole[0] == 3
    assert whole != recheck.digest(items.withColumn("code", F.when(F.col("id") == "b", ".b{top:2px}").otherwise(F.col("code"))))
    assert whole != recheck.digest(items.unionByName(items.where("id = 'a'")))
    with pytest.raises(recheck.CatalogMovedError):
        recheck.recheck(items.withColumn("stamp", F.current_timestamp().cast("string")))


def test_calls_of_a_hot_key_are_cut_where_a_window_is_empty(spark):
    r = random.Random(4)
    rows, at = [], 0
    for i in range(900):
        at += r.choice([1, 1, 1, 2, 9, 10, 11, 700])
        rows.append((i, r.choice(["hot", "hot", "hot", "cold", None]), at))
    df = spark.createDataFrame(rows, "event_id long, user_id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {x["event_id"]: x["admitted"] for x in admission.admitted(df, most=3, seconds=10).collect()}
    last, want = {}, {}
    for i, k, t in rows:
        mine = last[k] = [x for x in last.get(k, []) if t - x < 10]
        want[i] = len(mine) < 3
        if want[i]:
            mine.append(t)
    assert got == want
    some = admission.sessions(df.select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), F.unix_micros("ts").alias("at")), 10_000_000)
    assert some.where("key = 'hot'").select("since").distinct().count() > 50
    assert [x["admitted"] for x in admission.admitted(df.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))).collect()] == [False]


def test_blocks_are_composed_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK", 16)
    monkeypatch.setattr(shards, "FAN", 3)
    r = random.Random(6)
    sizes = [r.choice([1, 5, 30, 90]) for _ in range(700)]
    order = sorted(r.sample(range(-(10**15), 10**15), 700))  # as sparse as hashes
    rows = spark.createDataFrame(list(zip(order, sizes, strict=True)), "o long, s long").repartition(5)
    got = {x["o"]: x["shard"] for x in shards.assigned(rows, "o", "s", 100, 6).collect()}
    assert [got[o] for o in order] == shards.greedy(sizes, 100, 6)[0]
    at, shard = shards._step([3, 4, 9], [1, 1, 2], np.array([0, 7]), np.array([0, 5]))
    assert at.tolist() == [3, 9] and shard.tolist() == [1, 7]


def test_uniforms_have_the_default_of_their_note():
    code = "uniform float a /* = 1.5 */; // = 9\nuniform vec2 b; // = vec2(1.0, -2e1)\nuniform bool c; // = true\nuniform\n  int d ; float z; // = 7\nuniform mat2 m; // = 3\nuniform float e /* 4 */;\nuniform sampler2D f;\n"
    assert list(glsl.uniforms(glsl.marks(code))) == [("float", "a", "1.5 "), ("vec2", "b", "vec2(1.0, -2e1)"), ("bool", "c", "true"), ("int", "d", "7"), ("sampler2D", "f", "")]
    assert glsl.figures("vec2", "vec2(1.0, -2e1)") == [1.0, -20.0] and glsl.figures("bool", "true") == [1.0] and glsl.figures("float", "") == [0.5]
    one, two = glsl.signature("float a = 1.; // x\nfloat b = a*a;"), glsl.signature("float q = 1.;/* y */float r = q * q;")
    assert one[0] == two[0] and one[2] == ["float", "v0", "=", "1.", ";", "float", "v1", "=", "v0", "*", "v0", ";"] and glsl.signature(" ")[4]
