"""Exports, paths, the recheck, and the build with repairs, reviews and removals, on small records."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import catalog
from tesserae.functions import text as T
from tesserae.functions import urls
from tesserae.operators import consolidate, exports, passages, recheck, reviews, search, shards, validate
from tesserae.operators.audits import image, palette
from tesserae.sources import paths, scans

from .test_operators import records, sheet


def test_details_are_named_by_content_and_stale_ones_go(spark, tmp_path):
    items = spark.createDataFrame([(f"i{n:03}", n, "x" * 20_000) for n in range(70)], "id string, pos long, code string")
    files, paths_ = exports.details(items)
    rows = files.collect()
    assert all(hashlib.sha256(r["body"].encode()).hexdigest() == r["sha256"] and r["path"] == f"catalog-details/{r['sha256']}.json" and len(r["body"]) == r["bytes"] <= 512 * 1024 for r in rows)
    assert [json.loads(r["body"])["items"][0]["id"] for r in sorted(rows, key=lambda r: r["shard"])] == ["i000", "i026", "i052"] and paths_.count() == 70
    assert exports.write_details(files, str(tmp_path)) == {"written": 3, "kept": 0, "removed": 0} and exports.detail_faults(files, str(tmp_path)).collect() == []
    when = {n: os.stat(tmp_path / "catalog-details" / n).st_mtime_ns for n in os.listdir(tmp_path / "catalog-details") if not n.startswith(".")}
    fewer, _ = exports.details(items.where("pos < 52"))
    assert {r["fault"] for r in exports.detail_faults(fewer, str(tmp_path)).collect()} == {"stale"}
    assert exports.write_details(fewer, str(tmp_path)) == {"written": 0, "kept": 2, "removed": 1}
    left = [n for n in os.listdir(tmp_path / "catalog-details") if not n.startswith(".")]
    assert len(left) == 2 and all(os.stat(tmp_path / "catalog-details" / n).st_mtime_ns == when[n] for n in left)


def test_shards_begin_where_a_walk_says(spark, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK", 16)
    sizes = [(i * 37) % 60 for i in range(500)]
    rows = spark.createDataFrame([(i * i, s) for i, s in enumerate(sizes)], "o long, s long").repartition(5)
    got = {r["o"]: r["shard"] for r in shards.assigned(rows, "o", "s", 100, 6).collect()}
    assert [got[i * i] for i in range(500)] == shards.greedy(sizes, 100, 6)[0]
    assert shards.assigned(rows.limit(0), "o", "s", 100, 6).collect() == []
    with pytest.raises(Exception, match="larger than a shard"):
        shards.assigned(rows, "o", "s", 50, 6).collect()


def test_collections_and_composition(spark, tmp_path):
    rows = [("a", 0, "animation", "code", "motion"), ("b", 1, "palette", "palette", "design"), ("c", 2, "reference", "reference", None)]
    items = spark.createDataFrame(rows, "id string, pos long, category string, kind string, domain string")
    counts = {r["collection"]: r["n"] for r in exports.collection_counts(items).collect()}
    assert len(counts) == 15 and counts["animation"] == counts["domain-design"] == 1 and counts["loader"] == 0
    exports.write_collections(items, str(tmp_path / "c"))
    assert {r["collection"] for r in spark.read.json(str(tmp_path / "c" / "collections")).collect()} == {"animation", "palette", "reference", "domain-motion", "domain-design"}
    assert exports.composition(items, "2026-01-31") == {"motion": 1, "design": 1, "references": 1}
    for bad in (items.withColumn("domain", F.lit(None).cast("string")), None):
        with pytest.raises((exports.CompositionError, ValueError)):
            exports.composition(bad if bad is not None else items, "2026-1-31" if bad is None else None)


def test_chart_and_marked_text():
    assert exports.chart({"a": 1, "b": 3}).count("<circle") == 2 and "(75.0%)" in exports.chart({"a": 1, "b": 3}) and "(0.0%)" in exports.chart({"a": 0})
    text = "x\n<!-- m -->\nold\n<!-- /m -->\ny"
    assert exports.between(text, "m", " new ") == "x\n<!-- m -->\nnew\n<!-- /m -->\ny"
    with pytest.raises(ValueError, match="marked"):
        exports.between(text + "<!-- m -->", "m", "")


def test_paths_stay_below_their_root(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("{}")
    (tmp_path / "index.html").write_text("")
    (tmp_path / "a" / "x.py").write_text("")
    os.symlink(tmp_path / "a" / "x.json", tmp_path / "l.json")
    root = str(tmp_path)
    assert paths.static_path(root, "/a/x.json?q=1") == f"{root}/a/x.json" and paths.static_path(root, "/") == f"{root}/index.html"
    for bad in ("/../x.json", "/a/.x.json", "/a/x.py", "/none.json", "/l.json", "/%2e%2e/x.json", "/a\\x.json", "/%252e/x.json", "a/x.json", "/a/x.json\x00"):
        assert paths.static_path(root, bad) is None, bad
    assert paths.checked_path(f"{root}/none", root, missing=True) == f"{root}/none"
    for bad in (f"{root}/none", f"{root}/l.json", "/etc"):
        with pytest.raises(paths.PathError):
            paths.checked_path(bad, root)


def test_extracted_lines_and_rebuilt_components(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sources = spark.createDataFrame([("f", bytearray(b"one\ntwo\nthree\n"))], "name string, content binary")
    pieces = spark.createDataFrame([("c", 0, "f", 1, 2, sha("one\ntwo\n")), ("c", 1, "f", 3, 3, sha("three\n")), ("d", 0, "f", 2, 9, "x"), ("e", 0, "g", 1, 1, "x"), ("h", 0, "f", 1, 1, "x")], "id string, place int, name string, first int, last int, sha256 string")
    got = scans.extracted(sources, pieces)
    assert {r["id"]: r["error"] for r in got.collect()} == {"c": None, "d": "no such lines", "e": "no file", "h": "another digest"}
    repairs = spark.createDataFrame([("c", "one\ntwo\nthree\n"), ("d", "x"), ("z", "x")], "id string, code string")
    assert {r["id"]: r["fault"] for r in scans.rebuilt(got, repairs).collect()} == {"d": "a piece is lost", "z": "no source"}


def test_pictures_of_equal_names_in_two_folders(spark, tmp_path):
    body = bytes.fromhex("ffd8ffc0000b080040004001011100ffd9")
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.jpg").write_bytes(body)
    records_ = spark.createDataFrame([("a/x.jpg", 64, 64, hashlib.sha256(body).hexdigest()), ("c/x.jpg", 64, 64, "")], "path string, width int, height int, sha256 string")
    assert {r["path"]: r["error"] for r in scans.images(spark, str(tmp_path), records_).collect()} == {"a/x.jpg": None, "c/x.jpg": "no file"}


def test_pictures_of_like_colours(spark):
    rng = np.random.default_rng(1)
    plane = np.kron(rng.random((16, 16)), np.ones((8, 8)))
    other = np.clip(plane * 0.5, 0, 1)
    blob = lambda x: bytearray(x.astype("<f4").tobytes())
    rows = [("a", "1", blob(plane), blob(np.dstack([plane] * 3))), ("b", "2", blob(other), blob(np.dstack([plane] * 3))), ("c", "1", blob(plane), None), ("d", "4", blob(other), None)]
    got = {(r["a_id"], r["b_id"]): r["relation"] for r in image.audit(spark.createDataFrame(rows, "id string, sha256 string, plane binary, rgb binary")).collect()}
    assert got["a", "c"] == "exact" and got["a", "b"] == "near" and got["b", "d"] == "near" and ("a", "d") not in got


def test_palettes_of_several_sizes_and_pair_classes(spark):
    rows = [("a", ["#111111", "#222222"], "s", "n"), ("b", ["#222222", "#111111", "#333333"], "s", "n"), ("c", ["#111111", "#222222"], "s", "m"), ("d", ["#222222", "#111111"], None, "n")]
    df = spark.createDataFrame(rows, "id string, colors array<string>, source string, name string")
    [one] = palette.size_families(df).collect()
    assert (one["ids"], one["sizes"], one["shared"]) == (["a", "b"], [2, 3], ["#111111ff", "#222222ff"])
    assert {r["relation"]: r["n"] for r in palette.pair_classes(palette.prepared(df)[0]).collect()} == {"exact": 1, "reordered": 2, "near": 0, "candidate-reversed": 0, "candidate-matched": 0, "subset": 3, "different": 0}


def test_shared_runs(spark, monkeypatch):
    passage = spark.createDataFrame([(1, "one two three four five six"), (2, "a b")], "item long, text string")
    texts = spark.createDataFrame([(1, "zero one two three four five nine"), (2, "one two three"), (3, None), (4, "one two three four five one two three four five six")], "doc long, text string")
    want = [(1, 1, 2, 3), (1, 4, 3, 3)]
    for carried in (500_000, 0):
        monkeypatch.setattr(passages, "CARRIED", carried)
        got = passages.shared_runs(passage, "item", texts, "doc", "text", 4, 0.5).select("item", "doc", "shared", "n")
        assert sorted(map(tuple, got.collect())) == want


def test_texts_for_terminals_and_urls_again_encoded(spark):
    assert T.terminal_safe("a\x1b[0m\x85\n") == "a\\x1b[0m\\x85\n" and T.terminal_json({"k": "\x85\x01"}) == '{"k": "\\u0085\\u0001"}'
    rows = spark.createDataFrame([("https://a.org/?b=%7e%41&a=x y",), ("https://a.org/?q=a+b&z=%zz",), ("https://a.org/?é=1",)], "u string")
    assert [r["c"] for r in rows.select(urls.canonical_url(F.col("u")).alias("c")).collect()] == ["https://a.org/?a=x+y&b=~A", "https://a.org/?q=a+b&z=%25zz", "https://a.org/?%C3%A9=1"]


def test_recheck(spark):
    kind = "id string, kind string, language string, code string, colors array<string>, sourceUrl string"
    rows = [("a", "code", "css", sheet(), None, None), ("b", "code", "css", sheet("o"), None, None), ("c", "code", "css", sheet(middle="0.505"), None, None), ("p", "palette", "json", None, ["#111", "#222"], None), ("r", "reference", "link", None, None, "https://a.org"), ("x", "code", "css", "x {", None, None)]
    items = spark.createDataFrame(rows, kind)
    found, summary, verdict = recheck.recheck(items)
    assert {(r["domain"], r["section"]): (r["n"], r["open"]) for r in summary.collect()} == {("css", "exact"): (1, 1), ("css", "candidate"): (1, 1), ("css", "error"): (1, 1)}
    assert [tuple(r) for r in verdict.collect()] == [(3, False)]
    assert [(r["domain"], r["section"], r["a_id"], r["b_id"]) for r in recheck.reported(found).collect()] == [("css", "candidate", "a", "c"), ("css", "exact", "a", "b")]
    pair = found.where("section = 'candidate'").select("domain", "a_id", "b_id", "a_sha", "b_sha").withColumn("decision", F.lit("distinct"))
    sound = items.where("id not in ('b', 'x')")
    assert [tuple(r) for r in recheck.recheck(sound, pair)[2].collect()] == [(0, True)] and [tuple(r) for r in recheck.recheck(sound)[2].collect()] == [(1, False)]
    assert recheck.uncovered(items, recheck.findings(items.where("id <> 'r'"))[1]).collect()[0]["id"] == "r"


REVIEW = {
    "targetDomain": "motion", "resourceType": "example", "assetType": "loader", "effects": ["fade"], "components": [], "useCases": ["status"],
    "evidence": {"basis": "reviewed-source", "confidence": "high", "summaryKO": "요약", "summaryEN": "summary", "signals": [], "artifacts": [{"path": "a/b.txt", "sha256": "0" * 64}]},
    "preview": {"mode": "related-asset", "assetId": "i0", "limitations": ["none"]},
}


def test_build_with_repairs_reviews_and_removals(spark, tmp_path):
    link = {"kind": "reference", "category": "reference", "language": "link", "code": None}
    base = records(spark, {"title": "A"}, {"title": "B", "code": sheet("q")}, {"title": "L"} | link, {"title": "M"} | link, {"title": "P", "kind": "palette", "category": "palette", "language": "json", "code": '["#111","#222"]', "colors": ["#111", "#222"]})
    plain = {r["id"]: r for r in catalog.build([("base", base)])["items"].collect()}
    policy = spark.createDataFrame([("i0", m, "component", plain[m]["code_sha"], plain[m]["record_sha"]) for m in ("i0", "i1")], "group string, member string, mode string, code_sha string, record_sha string")
    repairs = spark.createDataFrame([("i0", ".fixed{top:0}")], "id string, code string")
    said = {"id": "i2", "sourceSha256": plain["i2"]["record_sha"]} | REVIEW
    human = spark.createDataFrame([("i2", json.dumps(said))], "id string, review string")
    gone = spark.createDataFrame([("i3", plain["i3"]["record_sha"], "closed", "private", "2026-01-01")], "id string, source_sha256 string, reason string, status string, verified_at string")
    parts = catalog.build([("base", base)], policy=policy, removed=gone, repairs=repairs, reviews=human)
    rows = {r["id"]: r for r in parts["items"].collect()}
    assert sorted(rows) == ["i0", "i2", "i4"] and rows["i0"]["code"] == ".fixed{top:0}" and [v["variant_role"] for v in rows["i0"]["variants"]] == ["motion-variant", "component-part"]
    assert (rows["i2"]["asset_type"], rows["i2"]["target_domain"], rows["i2"]["preview_asset"], rows["i2"]["effects"]) == ("loader", "motion", "i0", ["fade"])
    path = str(tmp_path / "bundle")
    catalog.publish(parts, path, "v1")
    c = catalog.Catalog(spark, path)
    checks = {r["check"]: r["faults"] for r in c.verify().collect()}
    assert len(checks) > 20 and not any(checks.values()), {k: v for k, v in checks.items() if v}
    assert c.reconstructed(parts).collect() == []
    assert [i["id"] for i in c.search(query="요약")["items"]] == ["i2"]
    assert {r["id"]: r["variants"] for r in exports.discovery(c.part("items")).select("id", F.size("variant_titles").alias("variants")).collect()}["i0"] == 2
    assert exports.browse(c.part("items"), exports.details(c.part("items").select("id", "pos", "title"))[1]).where("detail_shard is null").count() == 0
    counts = {(r["field"], r["value"]): r["n"] for r in exports.review_counts(c.part("items").where("kind = 'reference'")).collect()}
    assert counts[("totals", "total")] == counts[("targetDomains", "motion")] == counts[("previewModes", "related-asset")] == 1
    for bad in (
        {"removed": gone.withColumn("source_sha256", F.lit("x"))}, {"removed": gone.withColumn("id", F.lit("i0"))}, {"repairs": repairs.withColumn("id", F.lit("i4"))}, {"reviews": human.withColumn("id", F.lit("i3"))}, {"reviews": human.limit(0)},
        {"reviews": spark.createDataFrame([("i2", json.dumps(said | {"sourceSha256": "1" * 64}))], "id string, review string")},
    ):
        with pytest.raises(validate.RecordError):
            catalog.build([("base", base)], **({"policy": policy, "removed": gone, "repairs": repairs, "reviews": human} | bad))
    assert {r["id"]: r["fault"] for r in consolidate.unused_repairs(policy, repairs.union(repairs)).collect()} == {"i0": "given twice"}
    assert reviews.removal_faults(gone, parts["items"]).collect()[0]["faults"] == ["no record"]


def test_keys_are_resolved_through_one_alias(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    aliases = spark.createDataFrame([("x", "a"), ("b", "a"), ("y", "none")], "alias string, item_id string")
    keys = spark.createDataFrame([("a",), ("b",), ("x",), ("y",), ("z",)], "key string")
    assert sorted((r["key"], r["n"], r["canonical_id"]) for r in search.resolved(items, aliases, keys).collect()) == [("a", 1, None), ("b", 2, None), ("x", 1, "a")]
