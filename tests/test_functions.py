"""Scalar functions against plain Python and SQLite's full-text search."""

import itertools
import math
import sqlite3
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import color, css, matching, urls
from tesserae.functions import text as T
from tesserae.operators import search as S
from tesserae.sources import scans


def one(spark, expr, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expr.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.COM/a/b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b?a=1&b=2"),
        ("http://example.com", "http://example.com/"),
        ("https://example.com/?fbclid=1&GCLID=2&q=", "https://example.com/?q="),
        ("ftp://example.com/", None),
        ("https://user@example.com/", None),
        ("https:///path", None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.col("u")), u=url) == want


def test_project_url(spark):
    made = lambda u: one(spark, urls.project_url(F.col("u")), u=u)
    assert made("https://GitHub.com/Own/Repo/tree/main?x=1") == "https://github.com/own/repo"
    assert made("https://github.com/own") == "https://github.com/own"
    assert made("https://polyhaven.com/a/wood?x") == "https://polyhaven.com"
    assert one(spark, urls.normalized_url(F.col("u")), u="HTTP://A.org/P?b=1&a=2#F") == "http://a.org/P?b=1&a=2#F"


@pytest.mark.parametrize(("c", "want"), [("#ABC", "#aabbccff"), ("#abcd", "#aabbccdd"), ("#A1B2C3", "#a1b2c3ff"), ("#a1b2c3d4", "#a1b2c3d4"), ("red", None), ("#12345", None)])
def test_canonical_color(spark, c, want):
    assert one(spark, color.canonical_color(F.col("c")), c=c) == want


def lab(rgb):
    light = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in rgb]
    cone = [sum(w * x for w, x in zip(row, light, strict=True)) ** (1 / 3) for row in color.LMS]
    return [100 * sum(w * x for w, x in zip(row, cone, strict=True)) for row in color.LAB]


def test_oklab(spark):
    got = one(spark, color.oklab6(F.col("c")), c="#3366cc80")
    rgb, a = [0x33 / 255, 0x66 / 255, 0xCC / 255], 0x80 / 255
    assert got == pytest.approx(lab([c * a for c in rgb]) + lab([c * a + 1 - a for c in rgb]))
    assert one(spark, color.oklab6(F.col("c")), c="#ffffffff")[0] == pytest.approx(100, abs=1e-3)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6).flatmap(lambda n: st.lists(st.lists(st.sampled_from([0, 1, 2, 3, 7, 1e9]), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_assignment_is_least(rows):
    costs = np.array(rows, float)
    found = matching.assignment(costs)
    assert sorted(found) == list(range(len(costs)))
    total = lambda p: sum(costs[i, j] for i, j in enumerate(p))
    assert total(found) == min(total(p) for p in itertools.permutations(range(len(costs))))


def test_sequence_ratio(spark):
    got = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "a")], "a string, b string").select(matching.sequence_ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in got] == [SequenceMatcher(None, "abcd", "bcde", autojunk=False).ratio(), 1.0, None]


def test_text(spark):
    assert one(spark, T.one_space(F.col("t")), t="a /* x */  b  'c  /* d */'\n") == "a b 'c  /* d */'"
    assert one(spark, T.canonical(F.col("t")), t='{"b": 1, "a": [1, null]}') == '{"a":[1,null],"b":1}'
    assert one(spark, T.shingles(F.split("t", " "), 3), t="a b c d") == ["a b c", "b c d"] and one(spark, T.shingles(F.split("t", " "), 3), t="a b") == []
    assert one(spark, T.formula_guarded(F.col("t")), t="  =1") == "'  =1" and one(spark, T.formula_guarded(F.col("t")), t="a=1") == "a=1"
    assert one(spark, T.in_vocabulary(F.array(F.lit("b"), F.lit("z"), F.lit("a")), ("a", "b", "c")), t=1) == ["a", "b"]
    assert one(spark, T.utf16_units(F.col("t")), t="a😀") == 3
    assert T.index_words("Café_bar-ß½") == ["cafe", "bar", "ß½"] and T.index_words("_") == []
    assert T.terminal_safe("a\x1b\n\x9b") == "a\\x1b\n\\x9b"
    assert one(spark, T.casefold(F.col("t")), t="Straße") == "strasse"


def test_css_reading():
    text = css.without_comments("a{content:'/* no */'} /* yes */ @media x{ .b{color:red;background:url(a;b)} }")
    assert "yes" not in text and "/* no */" in text
    assert [(h, p) for h, _, p in css.blocks(text)] == [("a", ()), (".b", ("@media x",)), ("@media x", ())]
    assert css.declarations("-webkit-mask: url(a;b); Color : red ;;x") == [("mask", "url(a;b)"), ("color", "red")]
    assert css.blocks("a{b") == [] and css.blocks("a}") == [] and css.blocks("a{'}") == [] and css.without_comments("a /* b") == ""
    assert css.literal(r"'\41 b' attr(x) ") == "Ab"


@pytest.mark.parametrize("bad", [b"", b"MLZ1\x00", b"XXXX\x00abc", scans.pack_payload({"a": 1})[:-2], scans.pack_payload({"a": 1}) + b"x", '{"a":1,"a":2}', '{"a":NaN}', '{"a":1e309}', "[]", b"MLZ1\x00" + zlib.compress(b" " * (9 << 20))])
def test_bad_payloads(bad):
    with pytest.raises(ValueError):
        scans.unpack_payload(bad)


def test_payloads(spark):
    record = {"b": "é", "a": [1, 2.5, None]}
    assert scans.unpack_payload(scans.pack_payload(record)) == record == scans.unpack_payload('{"b":"é","a":[1,2.5,null]}')
    df = spark.createDataFrame([(bytearray(scans.pack_payload(record)),), (bytearray(b"no"),)], "p binary")
    good, bad = (r["u"] for r in df.select(scans.unpacked("p").alias("u")).collect())
    assert good["error"] is None and '"é"' in good["payload"] and bad["payload"] is None


def test_jpeg_header():
    frame = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x0b\x08\x00\x40\x00\x80\x01\x01\x11\x00\xff\xd9"
    assert scans.jpeg_size(frame) == (128, 64)
    for bad in (frame[:-2], b"\x89PNG" + frame, frame.replace(b"\xc2", b"\xc4"), b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            scans.jpeg_size(bad)


def test_line_range(spark):
    assert one(spark, scans.line_range(F.col("t"), F.lit(2), F.lit(3)), t="a\nb\r\nc\nd") == "b\r\nc\n"


def test_arguments():
    assert S.checked({})["limit"] == 24
    for bad in ({"limit": True}, {"limit": 101}, {"limit": 0}, {"offset": -1}, {"category": "none"}, {"query": "x" * 241}, {"nope": ""}, [], {"query": 3}, {"query": "a\x01"}, {"effect": "zzz"}):
        with pytest.raises(S.ArgumentError):
            S.checked(bad)
    assert S.phrases("!!") is None and S.phrases("a_b c") == [["a", "b"], ["c"]]


CORPUS = ["The quick brown fox", "quick café foxes and the brown_bear", "nothing here", "fox fox fox jumps", "the the the", "brown foxtrot quick", "CAFÉ quick-brown", "ｆox １２"]


@pytest.mark.parametrize("query", ["fo", "quick brown", "the", "café", "brown_be", "quick_brown", "fox fo", "zz", "qui the"])
def test_search_ranks_as_sqlite(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(body, tokenize = 'unicode61 remove_diacritics 2')")
    con.executemany("insert into t(rowid, body) values (?, ?)", list(enumerate(CORPUS)))
    words = S.phrases(query)
    said = " ".join(f'"{w}"*' for w in __import__("re").findall(r"\w+", query))
    want = dict(con.execute("select rowid, bm25(t) from t where t match ?", (said,)).fetchall())
    items = spark.createDataFrame(list(enumerate(CORPUS)), "id int, body string").withColumn("tokens", T.tokens(T.fold("body")))
    got = {r["id"]: r["score"] for r in S.scored(items, "tokens", words).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    index = S.Index.build(items, "id", F.col("tokens"))
    assert {r["doc"]: r["score"] for r in index.search(words).collect()} == pytest.approx(want, abs=1e-9)
    assert not math.isnan(sum(want.values()))
