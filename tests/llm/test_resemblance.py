"""Pairs by shingle sets, against all pairs."""

import random

import pytest

from tesserae.llm import resemblance, simhash


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    shared = prose(60)
    texts = [prose(rnd.randrange(40, 160)) for _ in range(40)]
    for t in list(texts[:20]):
        for _ in range(3):
            copy = list(t)
            for _ in range(rnd.randrange(1, 6)):
                copy[rnd.randrange(len(copy))] = "edited"
            texts.append(copy)
    texts += [shared + prose(60) for _ in range(30)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("room", [1, 24])
def test_pairs_connect_what_all_pairs_connect(spark, monkeypatch, room):
    monkeypatch.setattr(resemblance, "ROOM", room)
    rows = corpus(room)
    sets = {i: set(resemblance.hashes(t, 5).tolist()) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r["a"], r["b"]): r["similarity"] for r in resemblance.pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() <= want and all(s >= 0.8 for s in got.values())

    def groups(pairs):
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {i: find(i) for i in sets}

    assert len(want) > 20 and groups(got) == groups(want)


def test_pairs_among_some(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = spark.createDataFrame([(i,) for i, _ in rows if i % 2], "x long")
    assert all(r["a"] % 2 and r["b"] % 2 for r in resemblance.pairs(docs, among=some).collect())


def test_sketch_agreement_estimates_resemblance():
    a = resemblance.hashes(" ".join(f"a{i}" for i in range(1000)), 5)
    b = resemblance.hashes(" ".join(f"a{i}" for i in range(100, 1100)), 5)
    assert abs((resemblance.sketch(a) == resemblance.sketch(b)).mean() - resemblance.resemblance(a, b)) < 0.12
    assert resemblance.resemblance(a[:0], a[:0]) == 1.0 and resemblance.resemblance(a, a[:0]) == 0.0


def test_stage_drops_near_copies_and_keeps_the_rest(spark):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    sets = {i: set(resemblance.hashes(t, 5).tolist()) for i, t in rows}
    alone = {a for a in sets if all(a == b or len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]) for b in sets)}
    assert alone <= kept and len(kept) < len(rows)
    assert not any(a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in kept for b in kept)


@pytest.mark.parametrize(("shared", "more", "other"), [(16, 2, 2), (8, 1, 1), (5, 1, 0), (4, 1, 0), (20, 2, 2)])
def test_short_texts_that_are_just_alike_are_found(spark, shared, more, other):
    rows = []
    for i in range(150):
        words = [f"p{i}x{j}" for j in range(shared + 4)]
        rows += [(2 * i, " ".join(words + [f"p{i}a{j}" for j in range(more)])), (2 * i + 1, " ".join(words + [f"p{i}b{j}" for j in range(other)]))]
    got = {(r["a"], r["b"]) for r in resemblance.pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(150)}


def edited(seed, copies, least, most):
    """Copies of one text of 400 words, each with runs of its five-word shingles replaced."""
    rnd = random.Random(seed)
    text = [f"w{rnd.randrange(5000)}" for _ in range(404)]
    rows = []
    for i in range(copies):
        copy = list(text)
        for _ in range(rnd.randrange(least, most + 1)):
            copy[rnd.randrange(len(copy))] = f"edit{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    return rows


def components(nodes, links):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in nodes}


@pytest.mark.parametrize(("least", "most"), [(3, 9), (4, 5)])
def test_a_large_group_of_edited_copies_stays_together(spark, least, most):
    rows = edited(most, 300, least, most)
    sets = {i: set(resemblance.hashes(t, 5).tolist()) for i, t in rows}
    want = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = [(r["a"], r["b"]) for r in resemblance.pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(got) <= set(want) and components(sets, got) == components(sets, want)
