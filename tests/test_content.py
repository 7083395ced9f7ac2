"""Files named by content: commit in two phases, attempts that fail, and aliases in ranges."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tesserae.sources import content, sinks


def rows(spark, bodies):
    df = spark.createDataFrame([(b,) for b in bodies], "body string").repartition(3)
    return df.select(F.concat(F.sha2("body", 256), F.lit(".txt")).alias("name"), "body")


def names(folder):
    return {n for n in os.listdir(folder) if n[0] != "."}


def named(body):
    return hashlib.sha256(body.encode()).hexdigest() + ".txt"


def test_a_version_replaces_another(spark, tmp_path):
    at = str(tmp_path / "c")
    first = content.write(rows(spark, ["a", "b", "한", "d", "a"]), at)
    assert first["written"] + first["kept"] == 5 and first["removed"] == 0  # two tasks may both write a file that is named twice
    assert names(at) == {named(b) for b in "ab한d"} and content.faults(spark, at).collect() == []
    assert content.write(rows(spark, ["b", "c"]), at) == {"written": 1, "kept": 1, "removed": 3}
    assert names(at) == {named("b"), named("c")} and {r["name"] for r in content.current(spark, at).collect()} == names(at)
    (tmp_path / "c" / named("b")).write_text("torn off")
    assert [tuple(r) for r in content.faults(spark, at).collect()] == [(named("b"), "changed")]
    assert content.write(rows(spark, ["b", "c"]), at) == {"written": 1, "kept": 1, "removed": 0} and content.faults(spark, at).collect() == []
    assert content.write(rows(spark, ["b"]).limit(0), at) == {"written": 0, "kept": 0, "removed": 2} and names(at) == set()
    assert os.listdir(tmp_path / "c" / ".content" / "new") == [] and len(os.listdir(tmp_path / "c" / ".content" / "versions")) == 1


@pytest.mark.parametrize(("wrong", "value"), [("name", "0.txt"), ("body", None), ("body", "")])
def test_a_failed_job_leaves_the_version_before_it(spark, tmp_path, wrong, value):
    at = str(tmp_path / "c")
    content.write(rows(spark, ["a", "b"]), at)
    before = {r["name"] for r in content.current(spark, at).collect()}
    bad = rows(spark, ["c", "d"]).withColumn(wrong, F.when(F.col("body") == "d", F.lit(value)).otherwise(F.col(wrong)))
    with pytest.raises(Exception, match="not the digest"):
        content.write(bad, at)
    assert {r["name"] for r in content.current(spark, at).collect()} == before <= names(at)
    assert len(os.listdir(tmp_path / "c" / ".content" / "versions")) == 1  # what the failed job had listed is gone


def test_parts_of_attempts_that_do_not_count_go(tmp_path):
    import pyarrow as pa

    writer = content.Writer(f"file://{tmp_path}", "v")
    batch = pa.record_batch([pa.array([named("a")]), pa.array([b"a"])], names=["name", "body"])
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert (first.written, second.kept) == (1, 1)
    writer.commit([second])
    assert os.listdir(tmp_path / ".content" / "versions" / "v") == [second.part] and (tmp_path / named("a")).read_text() == "a"


def test_aliases_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ALIASES_A_FILE", 7)
    aliases = spark.createDataFrame([(f"a{i:02}", f"i{i % 5}") for i in range(40)] + [("é\"", "i9")], "alias string, item_id string").repartition(4)
    assert sinks.write_alias_files(aliases, str(tmp_path)) == {"written": 6, "kept": 0, "removed": 0}
    for alias, want in [("a00", "i0"), ("a39", "i4"), ("é\"", "i9"), ("a075", None), ("zz", None), ("", None)]:
        assert sinks.alias_target(spark, str(tmp_path), alias) == want
    assert sinks.write_alias_files(aliases, str(tmp_path)) == {"written": 0, "kept": 6, "removed": 0}
    with pytest.raises(Exception, match="(?i)duplicate"):
        sinks.write_alias_files(aliases.union(aliases), str(tmp_path))


def scanned(df):
    """Rows that the one Parquet scan of a plan has given out, after it has run."""
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Adaptive" in node.nodeName():
            node = node.executedPlan()
        if node.nodeName().startswith("Scan"):
            return node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")


def test_a_lookup_reads_the_row_groups_that_may_have_the_key(spark, tmp_path):
    rows_ = spark.range(40_000, numPartitions=4).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.col("id").alias("n"))
    gone = hashlib.sha256(b"none").hexdigest()
    one = hashlib.sha256(b"123").hexdigest()
    got = {}
    for key in ("id", None):
        sinks.write_part(rows_, str(tmp_path / str(key)), key)
        back = spark.read.parquet(str(tmp_path / str(key)))
        got[key] = [scanned(back.where(F.col("id") == v)) for v in (gone, one)]
        assert [r["n"] for r in back.where(F.col("id") == one).collect()] == [123]
    assert got[None][0] > 0 and got["id"][0] == 0 and 0 < got["id"][1] <= 10_000
