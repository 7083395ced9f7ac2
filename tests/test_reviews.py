"""Reviews and receipts: positive, just outside the rule, and invalid."""

import hashlib
import json

import pytest

from tesserae.operators import reviews as R

GOOD = {
    "id": "r1", "sourceSha256": "0" * 64, "targetDomain": "mixed", "resourceType": "tool", "assetType": "reference", "effects": ["fade"], "components": [], "useCases": ["reference"],
    "evidence": {"basis": "metadata", "confidence": "low", "summaryKO": "요약", "summaryEN": "summary", "signals": ["s"], "artifacts": [{"path": "a/b.html", "sha256": "1" * 64}]},
    "preview": {"mode": "illustration", "language": "svg", "code": '<svg><rect fill="url(#g)"/></svg>', "license": "CC0-1.0", "notice": "own work", "attribution": "us", "limitations": ["a drawing"]},
}


def changed(**paths):
    out = json.loads(json.dumps(GOOD))
    for path, value in paths.items():
        *steps, last = path.split("__")
        at = out
        for s in steps:
            at = at[s]
        at[last] = value
    return json.dumps(out)


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        ({}, []), ({"targetDomain": "x"}, ["targetDomain"]), ({"effects": ["fade", "fade"]}, ["effects"]), ({"extra": 1}, ["extra"]), ({"sourceSha256": "A" * 64}, ["sourceSha256"]), ({"evidence__confidence": "high"}, ["evidence"]), ({"evidence__signals": ["s"] * 49}, ["evidence"]),
        ({"evidence__artifacts": [{"path": "../x", "sha256": "1" * 64}]}, ["evidence"]), ({"preview__code": "<svg><script/></svg>"}, ["preview"]), ({"preview__code": '<svg onload="x"/>'}, ["preview"]), ({"preview__code": '<svg><a fill="url(http://x)"/></svg>'}, ["preview"]), ({"preview__license": "MIT"}, ["preview"]),
        ({"preview": {"mode": "related-asset", "assetId": "a", "limitations": ["x"]}}, []), ({"preview": {"mode": "related-asset", "assetId": "a", "limitations": []}}, ["preview"]), ({"preview__language": "css", "preview__code": ".a{background:url(x)}"}, ["preview"]), ({"preview__language": "css", "preview__code": ".a{color:red}"}, []),
    ],
)
def test_review_rules(change, fault):
    assert R.faults(changed(**change)) == fault


def test_bound_reviews(spark):
    assert R.faults("no") == ["json"] and R.dom_nodes({"tag": "div", "children": [{"tag": "p"}]}) == 2 and R.dom_nodes({"tag": "div", "children": [{"tag": "P!"}]}) == 0
    rows = [("r1", json.dumps(GOOD)), ("r2", json.dumps(GOOD)), ("x", json.dumps(GOOD)), ("r3", changed(preview={"mode": "related-asset", "assetId": "none", "limitations": ["x"]}))]
    items = spark.createDataFrame([("r1", "reference", "0" * 64), ("r2", "reference", "1" * 64), ("r3", "reference", "0" * 64), ("r4", "reference", "z"), ("c", "code", "q")], "id string, kind string, record_sha string")
    df = spark.createDataFrame(rows, "id string, review string")
    assert {r["id"]: r["faults"] for r in R.bound(df, items).collect()} == {"r2": ["record changed"], "x": ["no record"], "r3": ["no such asset"]}
    assert [tuple(r) for r in R.uncovered(df, items).collect()] == [("r4", 0)]


def test_receipts(spark, tmp_path):
    (tmp_path / "u").mkdir()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    (tmp_path / "u" / "o.css").write_bytes(b"original")
    (tmp_path / "u" / "n.txt").write_bytes(b"A notice\r\nof two lines\r\n")
    receipt = lambda stored, o=sha(b"original"): (1, ("u/o.css", o), ("u/n.txt", sha(b"A notice\r\nof two lines\r\n")), stored)
    licence = "MIT\nA notice\nof two lines\nend"
    rows = [("a", "code", "x", licence, None, receipt(sha(b"x"))), ("b", "code", "y", licence, None, receipt(sha(b"x"))), ("c", "code", "x", "MIT", None, receipt(sha(b"x"), "0" * 64)), ("d", "image", None, licence, ("5", "9"), receipt("5"))]
    df = spark.createDataFrame(rows, f"id string, kind string, code string, licenseText string, image struct<sha256:string,sourceSha256:string>, receipt {R.RECEIPT}")
    got = sorted(map(tuple, R.receipt_faults(df, str(tmp_path)).collect()))
    assert got == [("b", "body differs"), ("c", "notice is not in the licence"), ("c", "original differs"), ("d", "another origin")]
