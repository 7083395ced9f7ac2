"""Queries on tables that the small ones do not hold: odd rows against the SQL, and rows that ask for several tasks."""

import duckdb

from tesserae.plans import registry


def both(spark, folder, name):
    """The rows of a query and of its SQL, sorted."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}/*.parquet')")
    df = registry.queries()[name](spark, str(folder))
    listed = ", ".join(f'"{c}"' for c in df.columns)
    return sorted(map(tuple, df.collect())), sorted(con.execute(f"select {listed} from ({registry.oracle_sql()[name]})").fetchall())


def test_cells_that_are_formulas_of_themselves(spark, tmp_path):
    texts = ["=1", " =1", "\x0b+1", "\x1c-1", "\xa0@a", " =1", "a=1", "", "\n", "﻿=1"]
    rows = [(5 * i + k, t) for i, t in enumerate(texts) for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = both(spark, tmp_path, "csv_formula_guard")
    assert got == want
    own = {texts[i // 5]: c for i, c in got if i % 5 == 4}
    assert {t for t, c in own.items() if c == "'" + t} == set(texts[:6])


def test_titles_that_differ_in_case_alone(spark, tmp_path):
    page = lambda i, url, title: (i, url, f"<title>{title}</title>")
    rows = [page(3, "http://a.org/x#top", "Groß"), page(4, "http://a.org/x", "GROSS"), page(5, "http://a.org/y", "b"), page(6, "https://a.org/z", "c"), page(1_000_006, "https://a.org/z?a=1&b=2", "C")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = both(spark, tmp_path, "dedup_url_title")
    assert got == want
    kept = dict(got)
    assert 3 in kept and 4 not in kept and kept[1_000_006].startswith("HTTPS://")  # of two pages of one number, the least address


def tasks(df):
    """How often Python work stands in the plan, and the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("ArrowEvalPython"), plan


def test_long_work_on_short_keys_has_several_tasks(spark, small):
    for name in ("svg_element_counts", "css_text_functions"):
        n, plan = tasks(registry.queries()[name](spark, small))
        assert n == 1 and "REPARTITION_BY_NUM" in plan[plan.index("ArrowEvalPython") :], name  # read once, behind the exchange
    for name in ("css_exact_classes", "css_near_classes", "css_motion_families", "palette_near_permuted"):
        assert "ArrowEvalPython [signatures" not in tasks(registry.queries()[name](spark, small))[1], name  # written once, as two sides read it


def test_equal_shaders_are_read_once(spark, tmp_path):
    from tesserae.operators.audits import glsl

    rows = spark.createDataFrame([(i, f"float a{i % 3} = 1.0;") for i in range(9)] + [(20, None), (21, None), (22, "float b = 2.0;")], "id long, code string")
    assert [tuple(r) for r in glsl.counted_sources(rows).collect()] == [(0, 9)] == [tuple(r) for r in glsl.counted(glsl.prepared(rows)).collect()]
    n, plan = tasks(glsl.counted_sources(rows))
    assert n == 1 and "partial_count" in plan[plan.index("ArrowEvalPython") :]  # below the reading: the texts are grouped


def test_few_rows_go_to_python_at_once(spark, small):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    registry.queries()["text_functions"](spark, small)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_texts_are_split_into_tokens_once(spark, small):
    for name, n in (("search_postings", 0), ("search_published", 0), ("postings_stats", 1)):
        plan = tasks(registry.queries()[name](spark, small))[1]
        assert plan.count("regexp_extract_all(") == n, name  # none: read from what was written


def test_a_documents_postings_meet_where_its_tokens_are_made(spark, small):
    plan = tasks(registry.queries()["postings_stats"](spark, small))[1]
    assert plan.count("Exchange hashpartitioning") == 2  # texts by document, counts by term


def test_terms_beside_documents(spark, tmp_path):
    """Documents of one number count once; marks are dropped; the pairs of a term and a document are not shuffled."""
    rows = [(1, "the Été ete"), (1, "The end"), (2, None), (None, "the the"), (3, ""), (4, "ÉTÉ ß the"), (4, "ÉTÉ ß the")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.queries()["lateral_terms"](spark, str(tmp_path))
    assert sorted(map(tuple, df.select("term", "docs", "occurrences", "furthest").collect())) == [("end", 1, 1, 2), ("ete", 2, 4, 3), ("the", 2, 6, 3), ("ß", 1, 2, 2)]
    plan = tasks(df)[1]
    assert "UDTF" not in plan and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
