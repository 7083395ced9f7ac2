"""Importance draw, Jaccard components and session versions against plain versions."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tesserae.llm import importance, jaccard, queries, sessions

duckdb = pytest.importorskip("duckdb")


def plain_versions(events, gap):
    out = []
    for user in sorted({e[0] for e in events}):
        mine, versions = [e for e in events if e[0] == user], []
        for batch in sorted({e[2] for e in mine}):
            far = sorted((e for e in mine if e[2] <= batch), key=lambda e: e[1])
            made = [[far[0]]]
            for e in far[1:]:
                if e[1] - made[-1][-1][1] <= gap:
                    made[-1].append(e)
                else:
                    made.append([e])
            for run in made:
                new = sum(e[2] == batch for e in run)
                if new:
                    start, end = run[0][1], run[-1][1]
                    held = [v for v in versions if start <= v[2] <= end and v[8] is None]
                    for v in held:
                        v[8:] = batch, start
                    versions.append([user, batch, start, end, len(run), new, len(held), sum(e[3] for e in run), None, None])
        out += versions
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("seed", "gap", "times", "rows", "batches", "span", "fan", "block"), [(1, 3, 300, 120, 12, 7, 2, 4), (2, 0, 8, 40, 4, 1, 3, 1000), (3, 10, 400, 160, 40, 20, 4, 1), (4, 5, 60, 1, 1, 16, 2, 8)])
def test_versions_equal_a_plain_fold(spark, seed, gap, times, rows, batches, span, fan, block):
    r = random.Random(seed)
    events = [(r.randrange(2), r.randrange(-times, times), r.randrange(batches), r.randrange(1 << 32)) for _ in range(rows)]
    got = sessions.versions(spark.createDataFrame(events, "user long, at long, batch long, value long"), gap, span, fan, block)
    assert sorted(map(tuple, got.collect()), key=str) == plain_versions(events, gap)


def test_a_long_session_crosses_shards_and_blocks(spark):
    """One user, one session at the end, filled from both sides and the middle over many batches."""
    events = [(7, 2 * i, b, i) for i in range(120) for b in [i * 37 % 29]]
    got = sessions.versions(spark.createDataFrame(events, "user long, at long, batch long, value long"), 2, span=4, fan=3, block=5)
    assert sorted(map(tuple, got.collect()), key=str) == plain_versions(events, 2)


def test_awkward_events(spark):
    rows = [(1, 5, 0, 4, "x"), (1, 5, 0, 4, "x"), (1, None, 0, 1, "x"), (None, 5, 0, 1, "x"), (1, 6, None, 1, "x"), (1, 7, 1, None, "x")]
    df = spark.createDataFrame(rows, "user long, at long, batch long, value long, node string")
    assert sorted(map(tuple, sessions.versions(df, 2).collect())) == [(1, 0, 5, 5, 2, 2, 0, 8, 1, 5), (1, 1, 5, 7, 3, 1, 1, 8, None, None)]
    assert sessions.versions(df.where("false"), 2).count() == 0


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    answer = con.execute(sql)
    return [d[0] for d in answer.description], answer.fetchall()


@pytest.mark.parametrize("name", ["op11_importance_draw", "op13_session_versions"])
def test_query_equals_its_sql(spark, small, name):
    names, want = sql_rows(small, queries.ORACLES[name])
    got = queries.QUERIES[name](spark, small).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_ring_is_the_crc_of_every_run():
    said = importance.words("Ab é9 -c, \x00\x7fZ über".encode())
    assert said == [b"ab", "é9".encode(), b"c", b"z", "über".encode()]
    for n in (1, 2, 3):
        runs = [b" ".join(said[i:j]) for j in range(1, len(said) + 1) for i in range(max(0, j - n), j)]
        assert sorted(importance.ring(said, n)) == sorted(map(crc32, runs))


def test_draw_equals_a_plain_one(spark):
    r = random.Random(3)
    said = ["alpha", "beta", "Gamma", "δέλτα", "eps9"]
    docs = [(i, " ".join(r.choices(said, [5, 4, 3, 2, 1], k=r.choice([0, 3, 19, 20, 60])))) for i in range(60)]
    docs += [(60, None), (61, ""), (5, docs[5][1]), (None, "alpha " * 30)]
    target = [("delta alpha " * 9,), (None,), ("δέλτα eps9 " * 7,)]
    size, n, share = 31, 3, 40

    def buckets(text):
        w = importance.words((text or "").encode())
        return len(w), [crc32(b" ".join(w[i:j])) % size for j in range(1, len(w) + 1) for i in range(max(0, j - n), j)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(buckets(x)[1])
    for (x,) in target:
        t.update(buckets(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + size) / ((s[b] + 1.0) * (t.total() + size)))) for b in range(size)]
    rows = []
    for d, x in docs:
        many, found = buckets(x)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((many, d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in rows if x[0] >= 20), key=lambda x: (-x[4], x[1] is None, x[1] or 0))
    rank = {(x[1], x[2]): i + 1 for i, x in enumerate(able[: share * len(able) // 100])}
    frame = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, n_words string")
    got = importance.draw(frame, spark.createDataFrame(target, "text string"), n, size, share=share)
    seen = [tuple(x) for x in got.collect()]
    assert sorted(x[:4] for x in seen if x[0] is not None) == sorted(x[1:] for x in rows if x[1] is not None)
    assert sorted(x[4] for x in seen if x[4]) == list(range(1, share * len(able) // 100 + 1))
    assert all(x[4] == rank.get((x[0], x[1])) for x in seen if x[0] != 5)
    assert importance.draw(frame.where("false"), spark.createDataFrame(target, "text string")).count() == 0


def plain_components(rows, width=3, percent=90):
    sets = [set(jaccard.shingles(t or "", width).tolist()) for _, t in rows]
    inverted, parent = defaultdict(list), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for h in s for j in inverted[h])
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[root(i)] = root(j)
        for h in s:
            inverted[h].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min((x for x in (low.get(root(i)), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def edited(seed, groups, most, lengths):
    r, said, rows = random.Random(seed), [f"w{i}" for i in range(300)], []
    boiler = r.choices(said, k=12)
    for _ in range(groups):
        base = [r.choice(said) for _ in range(r.choice(lengths))]
        for _ in range(r.choice([1, 4, most])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                i = r.randrange(len(w) or 1)
                w[i : i + 1] = r.choice([[], [r.choice(said)], [r.choice(said)] * 2])
            rows.append((len(rows), " ".join(w + boiler * r.choice([0, 1]))))
    return rows


def test_components_equal_a_plain_join(spark):
    rows = edited(5, 14, 50, [1, 2, 3, 12, 40, 120])
    n = len(rows)
    rows += [(n, ""), (n + 1, None), (n + 2, " \t\n"), (None, rows[3][1]), (3, rows[3][1]), (3, "one other text under this name"), (n + 3, "ONE Other text under\tthis name")]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, node string, h int")
    got = jaccard.components(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows)
    assert jaccard.components(df.where("false")).count() == 0


def test_components_of_a_table(spark, medium):
    df = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text")
    got = queries.op12_jaccard_components(spark, medium)
    assert sorted(map(tuple, got.collect()), key=str) == plain_components([tuple(x) for x in df.collect()])


def test_prefix_of_an_order_is_the_first_of_its_class():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64))
    for order in (0, 1):
        t, s = jaccard.ordered(h, order)
        assert s == (h % jaccard.CLASSES == order).sum() and len(t) == max(s, jaccard.prefix(200)) and len(set(t.tolist())) == len(t)
    few = np.array([5, 11, 17], np.uint64)  # none of the class of order 0
    assert jaccard.ordered(few, 0)[0].tolist() == [5] and jaccard.ordered(few, 0)[1] == 0
    assert [jaccard.prefix(n) for n in (1, 9, 10, 11, 20, 100)] == [1, 1, 2, 2, 3, 11]
