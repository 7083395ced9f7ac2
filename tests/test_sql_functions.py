"""SQL functions hold what the Column functions say; the dictionary of prefixes holds what the postings say."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import color, matching, sql, urls
from tesserae.functions import text as T
from tesserae.operators import search as S

URLS = [
    None, "", "x", "ftp://a/b", "HTTP://Example.ORG//", "https://u@h/x", "https://a.b/c//?b=2&a=1&utm_x=3&fbclid=1#f", "https://a.b/?q=%zz&x=%41&y=a+b&z=*~é", "https://github.com/O/R/tree/x", "https://GitHub.com/o",
    "https://polyhaven.com/a/b?c=d", "https://a.b/x\n?y", "https://a.b?x&&=y&k=a=b", "https://a.b/p?q=\n#\n",
]
COLORS = [None, "", "#abc", "#ABCD", " #a1B2c3 ", "#a1b2c380", "#12345", "red", "#abc\n"]


def both(spark, values, column, name):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    rows.createOrReplaceTempView("given_values")
    return rows.select(column.alias("y")).collect(), spark.sql(f"select {name}(x) as y from given_values").collect()


def test_built_in_functions_are_the_column_functions(spark):
    sql.register(spark)
    for values, column, name in (
        (URLS, urls.canonical_url(F.col("x")), "canonical_url"), (URLS, urls.project_url(F.col("x")), "project_url"), (COLORS, color.canonical_color(F.col("x")), "canonical_color"),
        (["a 1.5 -2", "", None, ".5e3"], T.numeric_skeleton(F.col("x")), "numeric_skeleton"),
        (["Ünï", None, ""], T.fold(F.col("x")), "fold_marks"), (["Straße", None], T.casefold(F.col("x")), "casefold"), (['{"b":1, "a":[ ]}', "no", None], T.canonical(F.col("x")), "canonical_json"),
    ):
        want, got = both(spark, values, column, name)
        assert want == got, name


def test_oklab_and_matching_from_sql(spark):
    sql.register(spark)
    want, got = both(spark, ["#ff8000ff", "#00000000", "#12345678"], color.oklab6(F.col("x")), "oklab6")
    assert all(w["y"] == pytest.approx(g["y"], abs=1e-12) for w, g in zip(want, got, strict=True))
    one = spark.sql("select seq_ratio('abcd', 'abxd') as r, min_assignment(array(oklab6('#ff0000ff'), oklab6('#00ff00ff')), array(oklab6('#00ff00ff'), oklab6('#ff0000ff'))) as m").head()
    want = spark.sql("select 'abcd' as a, 'abxd' as b").select(matching.sequence_ratio("a", "b").alias("r")).head()["r"]
    assert one["r"] == want and list(one["m"]["matching"]) == [1, 0] and one["m"]["most"] == pytest.approx(0)


def test_sql_functions_are_inlined(spark):
    sql.register(spark)
    plan = spark.sql("select canonical_color(x) from values ('#abc') t(x)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_tokens_beside_rows(spark):
    sql.register(spark)
    rows = [(1, "Ünder-score_d ÀB"), (2, None), (3, ""), (4, "a a a"), (5, "Ｘ１ ²½ İx Σς"), (6, "x" * 100_000)]
    items = spark.createDataFrame(rows, "id long, text string")
    items.createOrReplaceTempView("token_rows")
    got = {(r["id"], r["pos"], r["term"]) for r in spark.sql("select id, t.pos, t.term from token_rows, lateral tokenize(text) t").collect()}
    want = {(r["id"], r["pos"], r["term"]) for r in items.select("id", F.posexplode(T.tokens(T.fold(F.col("text")))).alias("pos", "term")).collect()}
    assert got == want and (4, 2, "a") in got and not any(i in (2, 3) for i, _, _ in got)


def test_usual_signs_need_no_python():
    import re

    usual = re.compile(f"[{T.UNMARKED}{T.MARKED}{T.MARKED.upper()}]")
    own = dict(zip(T.MARKED + T.MARKED.upper(), T.PLAIN + T.PLAIN.upper(), strict=True))
    for c in filter(usual.match, map(chr, [*range(0xD800), *range(0xE000, 0x110000)])):
        assert T.fold_text(c) == own.get(c, c), hex(ord(c))


def test_tokens_beside_rows_are_made_in_place(spark):
    sql.register(spark)
    texts = [None, "", "ÀÉ Ÿÿ ß·Æ “x” 漢字", "a" * 5000 + "é", "e\u0301 Å가 ᄀ\u1161", "Đđ ё Ё ij Ⅷ", "İI ΑΣ", "x\ud83d\ude00y".encode("utf-16", "surrogatepass").decode("utf-16")]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows.createOrReplaceTempView("marked_rows")
    got = spark.sql("select id, unmarked(text) as bare from marked_rows").collect()
    assert {r["id"]: r["bare"] for r in got} == {i: None if t is None else T.fold_text(t) for i, t in enumerate(texts)}
    beside = spark.sql("select id, t.pos, t.term from marked_rows, lateral tokenize(text) t")
    want = rows.select("id", F.posexplode(T.tokens(T.fold(F.col("text")))).alias("pos", "term"))
    assert sorted(beside.collect()) == sorted(want.collect())
    plan = beside._jdf.queryExecution().executedPlan().toString()
    assert "UDTF" not in plan and "Join" not in plan and "Generate posexplode" in plan


def test_dictionary_against_plain_counts_and_search(spark, tmp_path):
    random.seed(5)
    words = ["".join(random.choices("abé", k=random.randint(1, 9))) for _ in range(60)]
    docs = [(i, random.choices(words, k=random.randint(0, 12))) for i in range(80)] + [(80, None), (81, []), (82, ["𝒜bc𝒜", "𝒜bd"]), (83, ["w" * 50_000])]
    items = spark.createDataFrame(docs, "id long, tokens array<string>")
    want: dict[str, int] = {}
    for _, tokens in docs:
        for p in {t[:k] for t in tokens or () for k in range(1, min(len(t), S.PREFIX_CHARS) + 1)}:
            want[p] = want.get(p, 0) + 1
    assert {r["prefix"]: r["docs"] for r in S.prefix_documents(items, F.col("tokens")).collect()} == want
    counted = S.Index.build(items.where("tokens is not null"), "id", F.col("tokens"))
    counted.with_dictionary(items, F.col("tokens")).write(str(tmp_path))
    known = S.Index.read(spark, str(tmp_path), dictionary=True)
    for phrase in ([["a"]], [["ab"], ["b"]], [["a", "b"]], [["zzz"]], [["w" * 20]], [["𝒜b"]], [[]]):
        a, b = ({r["doc"]: round(r["score"], 9) for r in i.search(phrase).collect()} for i in (counted, known))
        assert a == b, phrase
    empty = items.limit(0)
    assert S.prefix_documents(empty, F.col("tokens")).count() == 0
    assert "EqualTo(prefix,ab)" in known.search([["ab"]])._jdf.queryExecution().executedPlan().toString()
