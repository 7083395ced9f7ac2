"""Toxicity, exact search, tool calls and the pipeline, against plain implementations."""

import itertools
import json
import random

import numpy as np
import pytest

import corpus_pipeline
from tesserae.llm import packing, queries, toolcalls, toxicity, vafile
from tesserae.llm.components import least_labels

from .rows import awkward, folder, nothing


def plain_kernel(a, b):
    def features(row):
        out = {}
        for i, j, k in itertools.combinations(range(len(row)), 3):
            if toxicity.GAP not in (row[i], row[j], row[k]):
                u = (row[i], row[j], row[k])
                out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    fa, fb = features(a), features(b)
    return sum(v * fb.get(u, 0) for u, v in fa.items())


def test_kernel_equals_the_sum_over_subsequences():
    rows = toxicity.coded(["idiot", "i-d.iot", "loweient", "aaaa", "ab", "x.y.z.w", "chllaé"])
    for i, j in itertools.product(range(len(rows)), repeat=2):
        assert toxicity.kernel(rows[i : i + 1], rows[j : j + 1])[0] == pytest.approx(plain_kernel(list(rows[i]), list(rows[j])))


SENTENCES = [("you idiot.\nthe table is here", 1), ("what a moron you are", 1), ("so stupid. a window", 1), ("the table and a window. the garden", 0), ("morning in the garden", 0), ("students at the table", 0)]


def test_the_svm_of_labelled_sentences_equals_a_plain_one(spark):
    """Kernel, whitening, worst strings and decision, against plain numpy over explicit kernels."""
    telling, others = ["idiot", "moron", "stupid"], ["table", "window", "garden", "morning"]
    marks = toxicity.Landmarks(telling + others)
    words = sorted({w.strip(".") for t, _ in SENTENCES for w in t.split()})

    def k(a, b):
        x, y = (list(toxicity.coded([w])[0]) for w in (a, b))
        own = plain_kernel(x, x) * plain_kernel(y, y)
        return plain_kernel(x, y) / np.sqrt(own) if min(len(a), len(b)) > 2 else 0.0  # shorter strings have no triples of letters

    gram = np.array([[k(a, b) for b in marks.words] for a in words])
    assert marks.similar(words) == pytest.approx(gram, abs=1e-5)
    white = marks.whitening()
    own = np.array([[k(a, b) for b in marks.words] for a in marks.words])
    assert white.T @ own @ white == pytest.approx(np.eye(white.shape[1]), abs=1e-3)
    x = np.c_[gram @ white, np.ones(len(words))]
    y = np.array([1.0 if w in telling else -1.0 for w in words])
    weight = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum()) * toxicity.COST
    w = toxicity.solved(lambda v: toxicity.newton(x, y, weight, v), x.shape[1])
    ridge = np.r_[np.ones(len(w) - 1), 1e-3]
    slack = np.maximum(0, 1 - y * (x @ w))
    assert ridge * w == pytest.approx(x.T @ (weight * y * slack), rel=1e-3, abs=1e-3 * np.abs(ridge * w).max())  # the gradient is zero
    model = toxicity.Model(marks.folded(white @ w[:-1]), float(w[-1]))
    assert model.words(words) == pytest.approx(x @ w, abs=1e-2)
    for text, toxic in SENTENCES:
        [found] = toxicity.worst_strings(model, [text], [toxic], {})
        values = dict(zip(words, model.words(words), strict=True))
        if toxic:
            assert found == [max(values, key=lambda w: values[w] if w in text else -9)]
        else:
            assert all(values[w] > -1 for w in found)


def test_rounds_of_training_tell_the_classes_apart(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    values = dict(zip(["idiot", "moron", "stupid", "scumbag", "table", "window", "things"], model.words(["idiot", "moron", "stupid", "scumbag", "table", "window", "things"]), strict=True))
    assert all((v > 0) == (w in ("idiot", "moron", "stupid", "scumbag")) for w, v in values.items())
    assert (model.words(["i-d-i-o-t", "st.upid", "idi0t"]) > model.words(["garden"])[0]).all()


def test_sentences_end_at_signs_and_lines():
    said = toxicity.sentences("One two. Three i.d.i.o.t!\nfour four")
    assert said == [["one", "two."], ["three", "i.d.i.o.t!"], ["four"]]
    assert toxicity.sentences(" \n ") == []


def test_letters_written_apart_are_one_string():
    assert "idiot" in toxicity.strings("you i d i o t there") and "abc" not in toxicity.strings("a b cd")


def labelled(spark, n=240):
    rnd = random.Random(1)
    good = ["thing", "over", "under", "garden", "window", "morning", "people", "water", "table", "paper"]
    bad = ["idiot", "moron", "stupid", "scumbag"]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(good) + rnd.choice(["", "s", "ly"]) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words[rnd.randrange(30)] = rnd.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, toxicity.learnable(labels))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert len(rows) > 20 and np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in rows]) > 0.95
    hidden = spark.createDataFrame([(0, "some water and an i.d.i.o.t here"), (1, "some water on a table")], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(hidden, model).collect()}
    assert found[0] > 0.5 > found[1]


def test_toxicity_on_awkward_rows(spark, tmp_path):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    scores = toxicity.score(awkward(spark), model).collect()
    assert len(scores) == awkward(spark).count() and all(0 <= r["score"] <= 1 for r in scores)
    least = min(r["score"] for r in scores)
    assert {r["score"] for r in scores if r["doc_id"] in (0, 1, 2, 3)} == {least}
    kept = toxicity.keep_civil(awkward(spark), model)
    assert kept.columns == awkward(spark).columns and kept.count() == awkward(spark).count()
    assert toxicity.score(nothing(spark), model).collect() == []
    blank = toxicity.train(awkward(spark), labels.limit(0))
    assert {r["score"] for r in toxicity.score(awkward(spark), blank).collect()} == {0.0}
    path = folder(spark, tmp_path, documents=awkward(spark), labels=labels.limit(0))
    assert queries.QUERIES["op6_toxicity"](spark, path).count() == awkward(spark).count()


def plain_topk(rows, k=10):
    sound = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in sound if i % 100 == 0}):
        for dim in {len(v) for i, v in sound if i == q}:
            mine = min(tuple(v) for i, v in sound if i == q and len(v) == dim)
            scores = sorted((-int(v @ np.array(mine)), i) for i, v in sound if i != q and len(v) == dim)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_exact_search_equals_the_plain_scan(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(vafile, "STEP", 64)
    monkeypatch.setattr(vafile, "QUERIES", 3)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(900, 6)).round(2 if seed else 6)
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    rows += [(10_000 + i, vectors[0].tolist()) for i in range(400)]  # a third of all rows is one vector
    rows += [(20_000, None), (20_001, []), (20_100, [float("nan")] * 6), (20_101, [None] * 6), (None, [0.0] * 6), (5, [1.0] * 6)]
    path = folder(spark, tmp_path, embeddings=spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, label int, rank int, q string").repartition(5))
    got = queries.QUERIES["op5_va_file_topk"](spark, path).collect()
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == plain_topk(single)


def test_search_with_repeated_ids_hot_vectors_and_long_components(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)).round(1))]
    rows += [(100, v.tolist()) for v in rng.normal(size=(40, 4)).round(1)] + [(100, [1.0, 1.0, 1.0, 1.0])] * 30  # an id of many rows
    rows += [(1000 + 100 * i, [2.0, 2.0, 0.0, 0.0]) for i in range(60)] + [(7, [2.0, 2.0, 0.0, 0.0])] * 15  # queries and copies of one vector
    path = folder(spark, tmp_path / "a", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6))
    assert sorted(map(tuple, queries.QUERIES["op5_va_file_topk"](spark, path).collect())) == plain_topk(rows)
    wide = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 3)) * 1e9)] + [(400, [1e300, -1e300, 5.0]), (401, [1e300, 1e300, -1e300])]
    rows = queries.QUERIES["op5_va_file_topk"](spark, folder(spark, tmp_path / "b", embeddings=spark.createDataFrame(wide, "vec_id long, embedding array<double>"))).collect()
    most = (1 << 63) - 1
    sound = {i: [max(-most - 1, min(most, int(np.floor(1024 * x)))) for x in v] for i, v in wide}
    scores = {(q, i): max(-most - 1, min(most, sum(a * b for a, b in zip(sound[q], x, strict=True)))) for q in (0, 100, 400) for i, x in sound.items() if i != q}
    want = []
    for q in (0, 100, 400):
        best = sorted((-s, i) for (p, i), s in scores.items() if p == q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, rows)) == want


def test_few_exact_vectors_are_read(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=8)).tolist()) for i in range(4000)]
    read = []
    plain = vafile.answers
    monkeypatch.setattr(vafile, "answers", lambda left, *more: (read.append((left.count(), left.select("key").distinct().count())), plain(left, *more))[1])
    found = vafile.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 400 = 0", 10).collect()
    assert len(found) == 100
    # of 4,000 vectors: about the answers themselves, for 10 queries
    assert read[0][0] < 10 * 30 and read[0][1] < 0.08 * 4000


def test_search_over_few_or_no_vectors(spark, tmp_path):
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in queries.QUERIES["op5_va_file_topk"](spark, folder(spark, tmp_path / "a", embeddings=one)).collect()] == [(0, 1, 1, 1024 * 1024 * 3)]
    assert queries.QUERIES["op5_va_file_topk"](spark, folder(spark, tmp_path / "b", embeddings=one.limit(0))).collect() == []


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    root = {n: n for pair in links for n in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in least_labels(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert least_labels(spark.createDataFrame([], "a long, b long")).collect() == []


TOOLS = {"sum": {"properties": {"a": {"type": "integer", "required": True, "minimum": 0}, "how": {"type": "string", "enum": ["fast", "exact"]}, "more": {"type": "array"}}, "additionalProperties": False}}


def test_tool_calls(spark):
    calls = [
        ("c1", None, "sum", '{ "how":"fast", "a": 1 }'), ("c2", "c1", "sum", '{"a": -1}'), ("c3", "c2", "sum", '{"a": "1", "zz": null}'), ("c4", "lost", "sum", '{"a": 3, "how": "slow"}'), ("c5", "c6", "sum", '{"a": 3}'), ("c6", "c5", "sum", '{"a": 3}'),
        ("c7", None, "other", "{}"), ("c8", None, "sum", "no json"), ("c9", None, "sum", None), ("c1", None, "sum", '{ "how":"fast", "a": 1 }'), (None, None, None, None), ("c10", None, "sum", '{"a": 2.5, "more": {}}'), ("c11", None, "sum", '{"b\\"": {"y": [1, 2], "x": null}, "a": 7}'),
    ]
    results = [("c1", "one"), ("c1", "also"), ("c2", None), ("ghost", "who?"), ("c11", 'say "hi"\n')]
    rows = toolcalls.link(spark.createDataFrame(calls, "call_id string, parent_id string, name string, arguments string"), spark.createDataFrame(results, "call_id string, content string"), TOOLS)
    got = {r["call_id"]: r for r in rows.collect()}
    assert len(got) == 13
    assert (got["c1"]["status"], got["c1"]["n_calls"], got["c1"]["n_results"], got["c1"]["level"]) == ("linked", 2, 2, 0)
    assert json.loads(got["c1"]["message"]) == {"arguments": {"a": 1, "how": "fast"}, "id": "c1", "name": "sum", "result": "also"}
    assert got["c1"]["message"].startswith('{"arguments":{"a":1,"how":"fast"},"id":"c1"')
    assert (got["c2"]["errors"], got["c2"]["level"]) == ("a: under 0", 1)
    assert (got["c3"]["errors"], got["c3"]["level"]) == ("a: not integer; unknown property", 2)
    assert (got["c4"]["waits"], got["c4"]["errors"], got["c4"]["level"]) == ("unknown call", "how: not one of the values", 0)
    assert got["c5"]["waits"] == got["c6"]["waits"] == "circle" and got["c5"]["level"] is None
    assert got["c7"]["errors"] == "unknown tool" and got["c8"]["errors"] == got["c9"]["errors"] == "arguments: no object"
    assert got["c10"]["errors"] == "a: not integer; more: not array" and got["ghost"]["status"] == "result without call" and got[""]["status"] == "invalid"
    assert json.loads(got["c11"]["message"])["result"] == 'say "hi"\n' and got["c11"]["errors"] == "unknown property"
    for r in got.values():
        json.loads(r["message"])


def test_levels_of_a_long_chain(spark):
    n = 300
    calls = spark.createDataFrame([(f"k{i}", f"k{i - 1}" if i else None) for i in range(n)], "call_id string, parent_id string")
    assert {r["call_id"]: r["level"] for r in toolcalls.levels(calls).collect()} == {f"k{i}": i for i in range(n)}


def test_tool_calls_of_awkward_conversations(spark, tmp_path):
    turns = [(1, 0, "user", "a b c d"), (1, 1, "assistant", None), (1, 2, "user", None), (None, 0, "user", ""), (2, None, "assistant", "x"), (1, 0, "user", "a b c d"), (3, 5, "assistant", "y" * 20_000), (4, 1, None, "z")]
    df = spark.createDataFrame([(*t, "n", 1, "up") for t in turns], "conv_id long, turn long, role string, text string, name string, level int, up string")
    rows = queries.QUERIES["op1_tool_calls"](spark, folder(spark, tmp_path / "a", conversations=df)).collect()
    assert {r["call_id"] for r in rows} == {"1:0", "1:2", "?:0", "2:?", "3:4"}
    assert queries.QUERIES["op1_tool_calls"](spark, folder(spark, tmp_path / "b", conversations=df.limit(0))).collect() == []


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs, labels = labelled(spark)
    more = [(1000, "a text of its own about nothing " * 9), (1001, "a text of its own about nothing " * 9), (1002, "write to someone@mail.org please"), (1003, ""), (1004, None)]
    full = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    path = folder(spark, tmp_path, documents=full, labels=labels)
    held, kept = full, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, path)
        assert held.columns == full.columns
        kept[name] = {r["doc_id"]: r["text"] for r in held.collect()}
    first, second, third = kept.values()
    assert 0 not in first and 1 in first and {1000, 1001, 1002} <= set(first)
    assert set(first) - set(second) >= {1001} and 1000 in second
    assert set(third) == set(second) and third[1002] == "write to [EMAIL] please"
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} == set(third)
    want = packing.pack(spark.createDataFrame([(k, v) for k, v in third.items()], "doc_id long, text string"), queries.BYTE_BPE, queries.BYTE_RANKS)
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in rows) == sorted((r["doc_id"], r["ids_crc32"]) for r in want.collect())


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    path = folder(spark, tmp_path, documents=awkward(spark), labels=labelled(spark)[1].limit(0))
    for df in (awkward(spark), nothing(spark)):
        held, seen = df, {}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, path)
            assert held.columns == df.columns
            seen[name] = sorted(((r["doc_id"], r["text"]) for r in held.collect()), key=str)
        packed = corpus_pipeline.STAGES[-1][1](spark, held, path).collect()
        rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
        assert seen["toxicity"] == rows  # without labels nothing is toxic
        if not rows:
            assert packed == [] and not any(seen.values())
            continue
        kept = [d for d, _ in seen["simhash_near_dedup"]]
        # texts without words are copies of the first, of equal texts the first stays, and so do what has no doc_id and different texts of one doc_id
        assert kept.count(0) == 1 and not {1, 2, 3} & set(kept) and kept.count(6) == 1 and 7 not in kept and kept.count(99) == 2 and kept.count(None) == 1
        assert {4, 9, 10, 11, 12} <= set(kept)
        texts = dict(seen["pii"])
        assert sorted(texts, key=str) == sorted(set(kept), key=str) and texts[12] == "[IP] [EMAIL] [PHONE] or [CARD]" and texts[0] is None
        assert {r["doc_id"] for r in packed} == set(kept) and [r["length"] for r in packed if r["doc_id"] == 0] == [1]


def test_pipeline_keeps_columns_with_clashing_names(spark, tmp_path):
    docs, labels = labelled(spark)
    clash = docs.selectExpr("doc_id", "text", "text as row", "doc_id as _id", "doc_id as root", "text as terms", "doc_id as toxic", "text as word", "doc_id as n", "text as _text", "doc_id as a", "doc_id as b")
    path, held = folder(spark, tmp_path, documents=clash, labels=labels), clash
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, path)
        assert held.columns == clash.columns
    rows = held.collect()
    assert rows and all(r["_id"] == r["doc_id"] == r["b"] and r["row"] == r["word"] for r in rows)


def test_a_word_is_valued_once_whatever_stands_at_its_edges():
    rng, asked = np.random.default_rng(1), []

    class Counted(toxicity.Model):
        def strings(self, flat):
            asked.extend(flat)
            return super().strings(flat)

    model, memo = Counted(rng.normal(size=toxicity.SYMBOLS**3), -0.5, np.ones(4), -1.0), {}
    words = {"idiot", "idiot,", "(idiot)", "¿idiot?!", "...", "½x", "a_b", "x" * 60, "x" * 60 + "!"}
    toxicity._learn(model, words, memo)
    assert sorted(w for w in asked if len(w) < 24) == ["", "a_b", "idiot", "½x"]
    assert {w: memo[w] for w in words} == pytest.approx(dict(zip(sorted(words), model.words(sorted(words)), strict=True)))
    seen = len(asked)
    toxicity._learn(model, {"idiot;", "a_b"}, memo)
    assert len(asked) == seen


def test_words_written_letter_by_letter_are_what_the_pattern_says():
    for text in ("i d i o t", "x. y, z! w", "a b c", "a  b\tc d", "\u3000a b c d", "_a b_ c! d", "...", "--- a_ b_ c_ d", "\x1ca \x85b c d", "a'b c d e f", "ab cd ef gh", "", "a b c d e; f g hi"):
        assert toxicity.spelt_out(text, text.split()) == ["".join(m.group().split()) for m in toxicity.SINGLES.finditer(text)], text
