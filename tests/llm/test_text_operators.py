"""Tokenisers, packing, sharding, fingerprints and personal data, against plain implementations."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserae.llm import bpe, digest, packing, pii, queries, sharding, simhash, store

from .rows import awkward, folder, nothing

WORD, BYTE = Tokenizer.from_file(queries.WORD_BPE), Tokenizer.from_file(queries.BYTE_BPE)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def same_rows(a, b):
    assert Counter(a) == Counter(b)


@pytest.fixture(scope="module")
def own():
    return bpe.word_bpe(queries.WORD_BPE)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_the_library_on_any_text(text):
    own = bpe.word_bpe(queries.WORD_BPE)
    ids = WORD.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids).decode() == WORD.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abdehinorst'", max_size=60))
def test_bpe_equals_the_library_on_dense_merges(text):
    assert bpe.word_bpe(queries.WORD_BPE).encode(text) == WORD.encode(text, add_special_tokens=False).ids


def test_bpe_is_linear_in_long_words(own):
    assert own.encode("ab" * 50_000) == WORD.encode("ab" * 50_000, add_special_tokens=False).ids


def test_codec_on_awkward_rows(spark):
    docs = awkward(spark)
    want = []
    for doc_id, text in texts_of(docs):
        ids = WORD.encode(text, add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(WORD.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same_rows([tuple(r) for r in bpe.digests(docs, queries.WORD_BPE).collect()], want)
    got = bpe.encode_and_decode(docs, queries.WORD_BPE).collect()
    same_rows([(r["doc_id"], tuple(r["ids"])) for r in got], [(d, tuple(WORD.encode(t, add_special_tokens=False).ids)) for d, t in texts_of(docs)])
    assert bpe.digests(nothing(spark), queries.WORD_BPE).collect() == []


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [(room, i) for i, room in enumerate(bins) if room >= s]
        if fits:
            bins[min(fits)[1]] -= s
        else:
            bins.append(capacity - s)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 70).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_best_fit_decreasing_equals_the_plain_walk(case):
    capacity, sizes = case
    counts = Counter(sizes)
    plan = packing.best_fit_decreasing(counts, capacity)
    fill, places = Counter(), {}
    for s, n in counts.items():
        bins, offsets = plan.place(np.full(n, s), np.arange(n))
        for b, o in zip(bins, offsets, strict=True):
            fill[b] += s
            places.setdefault(b, []).append((o, s))
    assert sorted(capacity - f for f in fill.values()) == sorted(plain_best_fit(sizes, capacity))
    for rows in places.values():
        end = 0
        for o, s in sorted(rows):
            assert o == end
            end += s


def test_packing_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = packing.pack(docs, queries.BYTE_BPE, queries.BYTE_RANKS).collect()
    want = []
    for doc_id, text in texts_of(docs):
        ids = [*BYTE.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        at = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(at, at[1:], strict=False))]
    same_rows([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        end = 0
        for o, n in sorted(held):
            assert o == end
            end += n
        assert end <= 2048
    assert len(by) == len(plain_best_fit([w[3] for w in want], 2048))
    assert packing.pack(nothing(spark), queries.BYTE_BPE, queries.BYTE_RANKS).collect() == []


@pytest.mark.parametrize("text", ["", "ªº 'S don't  x", "\x1c\x85\xa0", "日本", "a<|endoftext|>b", "½²", "  \n\n a \t"])
def test_byte_ids_equal_the_library(text):
    assert packing.byte_ids(text, queries.BYTE_BPE, queries.BYTE_RANKS) == BYTE.encode(text, add_special_tokens=False).ids


#: Letters of many scripts, marks, digits, blanks, apostrophes and what may be a special token.
MIXED = st.one_of(st.text(max_size=60), st.lists(st.sampled_from([*"aZäßéñÇ'’ .,;:!?-_0123456789½²ªº\n\t\r\x0b\x0c\x1c\x85\xa0\u2028\u200b日本👍🏽\u0301", "'s", "'LL", "don't", "<|endoftext|>", "<|startoftext|>", "the ", " and", "  "]), max_size=40).map("".join))


@settings(max_examples=400, deadline=None)
@given(MIXED)
def test_byte_ids_equal_the_library_on_any_text(text):
    assert packing.byte_ids(text, queries.BYTE_BPE, queries.BYTE_RANKS) == BYTE.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(MIXED)
def test_word_ids_equal_the_library_on_any_text(text):
    coder = store.word_ids(queries.WORD_BPE)
    assert np.frombuffer(coder.encode(text), coder.dtype).tolist() == WORD.encode(text, add_special_tokens=False).ids


def test_ids_of_the_driver_texts_equal_the_library(small):
    import pandas as pd

    coder = store.word_ids(queries.WORD_BPE)
    for text in pd.read_parquet(f"{small}/documents.parquet")["text"].fillna(""):
        assert np.frombuffer(coder.encode(text), coder.dtype).tolist() == WORD.encode(text, add_special_tokens=False).ids
        assert packing.byte_ids(text, queries.BYTE_BPE, queries.BYTE_RANKS) == BYTE.encode(text, add_special_tokens=False).ids


def least_capacity(sizes, shards):
    def need(c):
        n, fill = 1, 0
        for s in sizes:
            if fill + s > c:
                n, fill = n + 1, 0
            fill += s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if need(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_minimax_cuts_are_least(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "FIRST", 8)
    monkeypatch.setattr(sharding, "FAN", 4)
    rnd = random.Random(seed)
    n = rnd.choice([1, 7, 60, 250])
    places = sorted(rnd.sample(range(-9, 10 ** rnd.choice([3, 9])), n))
    sizes = [rnd.choice([8, 30, 900, 5000]) for _ in places]
    capacity, starts = sharding.minimax_cuts(spark.createDataFrame(list(zip(places, sizes, strict=True)), "place long, bytes long"), 5)
    assert capacity == least_capacity(sizes, 5)
    edges = [places[0], *starts, places[-1] + 1]
    loads = [sum(s for p, s in zip(places, sizes, strict=True) if a <= p < b) for a, b in zip(edges, edges[1:], strict=False)]
    assert len(loads) <= 5 and max(loads) <= capacity
    assert sorted(x for x in loads if x) == sorted(x for x in even_loads(sizes, capacity, 5) if x)


def even_loads(sizes, capacity, shards):
    """Loads where each cut is the group end nearest to its share that walks from both sides reach."""
    ends = [0]
    for x in sizes:
        ends.append(ends[-1] + x)
    total, reach = ends[-1], [ends[-1]]
    for _ in range(shards):
        reach.append(min(e for e in ends if e >= reach[-1] - capacity))
    cuts = [0]
    for i in range(1, shards):
        open_ = [e for e in ends if max(cuts[-1], reach[shards - i]) <= e <= cuts[-1] + capacity]
        cuts.append(min(open_, key=lambda e: (abs(e - total * i // shards), e)))
    return [b - a for a, b in zip(cuts, [*cuts[1:], total], strict=True)]


def test_shards_of_the_driver_texts_are_of_like_size(spark, small):
    rows = queries.QUERIES["op3_minimax_shards"](spark, small).groupBy("shard").sum("size").collect()
    loads = [r["sum(size)"] for r in rows]
    assert len(loads) == 24 and min(loads) > 0.6 * np.mean(loads)


def test_sharding_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = sharding.shard(docs, 5).collect()
    same_rows([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows], [(d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts_of(docs)])
    by_text, slots = {}, {}
    for r in rows:
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values()) and set(slots) <= set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(nothing(spark), 5).collect() == []


def plain_simhash(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, distance=2):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in codes:
        for b in codes:
            if a < b and (a ^ b).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in codes}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abAB éÉ\t\n\x0b", max_size=60))
def test_simhash_equals_the_plain_count(text):
    assert simhash.fingerprint(text) == plain_simhash(text)


def test_simhash_classes_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = simhash.classes(docs).collect()
    codes = {(d, t): plain_simhash(t) for d, t in texts_of(docs)}
    roots = plain_components(set(codes.values()))
    least = {}
    for (d, _), c in codes.items():
        if d is not None:
            least[roots[c]] = min(d, least.get(roots[c], d))
    want = [(d, plain_simhash(t), least.get(roots[plain_simhash(t)])) for d, t in texts_of(docs)]
    same_rows([(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows], want)
    assert simhash.classes(nothing(spark)).collect() == []


@pytest.mark.parametrize("room", [1, 4, 1000])
def test_links_connect_what_is_near_at_every_bucket_size(spark, monkeypatch, room):
    monkeypatch.setattr(simhash, "ROOM", room)
    rnd = random.Random(room)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    codes = {c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) for c in centres for _ in range(25)}
    codes = {c % (1 << 64) for c in codes}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    pairs = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long")).collect()
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2 for r in pairs)
    root = {c: c for c in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in pairs:
        root[find(r["a"])] = find(r["b"])
    want = plain_components(codes)
    got = {}
    for c in signed:
        got.setdefault(find(c), set()).add(c % (1 << 64))
    groups = {}
    for c, r in want.items():
        groups.setdefault(r, set()).add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_allocation_spends_what_is_needed():
    cost, chosen = simhash.allocate([[0, 5, 50], [0, 1, 9], [0, 2, 100]], 3)
    assert sum(t + 1 for t in chosen) == 3 and cost == 8 and chosen == [0, 0, 0]


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = awkward(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and ids.count(None) == 1 and ids.count(99) == 2  # two texts of one name are two documents
    assert simhash.one_of_each(nothing(spark)).collect() == []


def test_texts_that_share_a_name_and_links_beside_the_first_are_kept(spark):
    rnd = random.Random(11)
    prose = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    other = [" ".join(prose(90)) for _ in range(3)]
    rows = [(5, other[0]), (5, other[1]), (6, other[2]), (6, other[2]), (7, other[0])]
    kept = [tuple(r) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted([(5, other[0]), (5, other[1]), (6, other[2])])


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_personal_data_equals_the_plain_patterns(spark):
    rnd = random.Random(5)
    pieces = ["a@b.co", "x.y@mail-1.example.com", "@", "a@b", "1.2.3.4", "300.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+1234567890123456", "+1", "é", "😀", " ", ".", "-", "a@b.c_d@e.f", "12345678901234567890", "\n"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 12))) for _ in range(300)] + [None, "", "9" * 30_000, "a" * 30_000 + "@", "+" + "1 " * 5_000, "1." * 9_000, "a@b.co 1.2.3.4, " * 300, "é +1 (555) 010-9999;" * 65]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.counts(pii.find(docs)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        spans = plain_spans(text or "")
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k, _ in PATTERNS] == [sum(s[3] == k for s in spans) for k, _ in PATTERNS]
    assert pii.counts(pii.find(nothing(spark))).collect() == []


def test_terms_that_disclose_an_entity_are_spans(spark):
    rnd = random.Random(3)
    filler = [f"filler{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    some = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    rows = [(i, f"{some(12)} Zanzibarov writes from boss@secret.org {some(12)}") for i in range(6)]
    rows += [(100 + i, some(30)) for i in range(60)] + [(300, "a single visitor lone@hapax.net unusualword")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    values = lambda i, k: [s["value"] for s in spans[i] if s["kind"] == k]
    assert all("Zanzibarov" in values(i, "term") and values(i, "email") == ["boss@secret.org"] for i in range(6))
    assert spans[300][0]["value"] == "lone@hapax.net" and values(300, "term") == []  # one context is no evidence
    assert all(not spans[100 + i] for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Zanzibarov" not in clean[0] and "boss@" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == dict(rows)[100]


def test_terms_of_an_entity_seen_once_and_far_from_it(spark):
    rnd = random.Random(4)
    filler = [f"filler{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    some = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    rows = [(i, some(30)) for i in range(20_000)]
    rows += [(30_000, f"Quagmirovna {some(40)} writes.from@once.org {some(9)}"), (30_001, some(20) + " alone@other.net " + some(20))]
    rows += [(31_000 + i, f"{some(5)} Zanzibarov {some(40 + i)} boss@secret.org") for i in range(6)]
    spans = {r["doc_id"]: [s["value"] for s in r["spans"] if s["kind"] == "term"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[30_000] == ["Quagmirovna"] and spans[30_001] == []
    assert all(spans[31_000 + i] == ["Zanzibarov"] for i in range(6))
    assert sum(map(len, spans.values())) == 7


def test_sanitise_keeps_rows_and_columns(spark):
    docs = awkward(spark)
    done = pii.sanitise(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in done.collect()}
    assert texts[0] is None and texts[1] == "" and texts[12] == "[IP] [EMAIL] [PHONE] or [CARD]"


def test_store_round_trip_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    path = str(tmp_path / "store")
    store.write(docs, path, queries.WORD_BPE)
    want = [(d, [*WORD.encode(t, add_special_tokens=False).ids, 2]) for d, t in texts_of(docs)]
    same_rows([(r["doc_id"], tuple(r["ids"])) for r in store.read(spark, path).collect()], [(d, tuple(i)) for d, i in want])
    rows = sorted(store.catalogue(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in want), key=lambda d: (d is not None, d))
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    same_rows([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows], [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want])
    assert store.verify(spark, path).collect() == []
    chunks = spark.read.parquet(path).where("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()
    empty = str(tmp_path / "empty")
    store.write(nothing(spark), empty, queries.WORD_BPE)
    assert store.catalogue(spark, empty).collect() == []


def test_a_damaged_chunk_is_found(spark, tmp_path):
    path, bad = str(tmp_path / "store"), str(tmp_path / "bad")
    store.write(awkward(spark), path, queries.WORD_BPE)
    from pyspark.sql import functions as F

    rows = spark.read.schema(store.COLUMNS).parquet(path)
    rows.withColumn("payload", F.when(F.col("payload").isNotNull(), F.concat(F.lit(b"\x01\x00"), F.expr("substring(payload, 3)")))).write.partitionBy("kind").parquet(bad)
    with pytest.raises(Exception, match="damaged"):
        store.catalogue(spark, bad).collect()


def tampered(spark, tmp_path, change):
    """A store, and the same with its rows changed."""
    whole, bad = str(tmp_path / "whole"), str(tmp_path / "bad")
    store.write(awkward(spark), whole, queries.WORD_BPE)
    change(spark.read.schema(store.COLUMNS).parquet(whole)).write.partitionBy("kind").parquet(bad)
    return bad


def _gone(rows):
    lost = rows.where("kind = 'chunk'").selectExpr("min(digest) as d").head()["d"]
    return rows.where((rows["kind"] != "chunk") | (rows["digest"] != lost))


def _cut(rows):
    from pyspark.sql import functions as F

    return rows.withColumn("digests", F.when(F.octet_length("digests") > 32, F.expr("substring(digests, 33)")).otherwise(F.col("digests"))).withColumn("lengths", F.when(F.octet_length("lengths") > 4, F.expr("substring(lengths, 5)")).otherwise(F.col("lengths")))


def _swapped(rows):
    from pyspark.sql import functions as F

    return rows.withColumn("doc_id", F.when(F.col("doc_id") == 4, F.lit(6)).when(F.col("doc_id") == 6, F.lit(4)).otherwise(F.col("doc_id")))


def _missing(rows):
    return rows.where("kind <> 'recipe' or doc_id is null or doc_id <> 5")


def _moved(rows):
    from pyspark.sql import functions as F

    return rows.withColumn("before", F.when(F.col("doc_id") == 6, F.col("before") + 1).otherwise(F.col("before")))


@pytest.mark.parametrize("change", [_gone, _cut, _swapped, _missing, _moved])
def test_a_store_that_was_tampered_with_is_not_read(spark, tmp_path, change):
    bad = tampered(spark, tmp_path, change)
    for use in (store.catalogue, store.read):
        with pytest.raises(Exception, match="does not agree|is missing|do not agree"):
            use(spark, bad).collect()
    if change is not _gone and change is not _cut:
        assert store.verify(spark, bad).count() > 0


def plain_tree(leaves):
    level = list(leaves) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [hashlib.sha256(b"\x01" + b"".join(p)).digest() if len(p) == 2 else p[0] for p in pairs]
    return level[0]


def test_roots_are_those_of_a_plain_tree():
    for n in range(40):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        assert store.merkle(leaves) == plain_tree(leaves)


def test_cut_points_follow_the_content():
    ids = np.random.default_rng(0).integers(0, 40_000, 20_000).astype(np.uint16)
    a, b = store.cut_points(ids), store.cut_points(np.concatenate([ids[:17], ids[5_000:]]))
    assert a[-1] == 20_000 and all(y - x <= store.MOST for x, y in zip([0, *a], a, strict=False))
    assert len({20_000 - x for x in a} & {15_017 - x for x in b}) > 20


def test_digests(spark):
    docs = awkward(spark)
    rank = digest.fit(docs)
    rows = digest.compare(docs, rank).collect()
    order = sorted(texts_of(docs), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
    want = []
    for (d, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        want.append((d, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    same_rows([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows], want)
    prints = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[6] == prints[7] and prints[0] == prints[1] == {""}
    assert digest.compare(nothing(spark), digest.fit(nothing(spark))).collect() == []


def test_digest_levels_are_entropies():
    rng = np.random.default_rng(1)
    for _ in range(20):
        data = rng.integers(97, 97 + rng.integers(1, 27), 120).astype(np.uint8)
        for s, level in enumerate(digest.levels(data)):
            p = np.array(list(Counter(data[s : s + 32].tolist()).values())) / 32
            assert abs(level - (-(p * np.log2(p)).sum()) / 5 * (digest.LEVELS - 1)) < 1.01


def test_half_edited_texts_are_half_alike(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = digest.compare(docs, digest.fit(docs)).where("n_chars > 1000").select("near_edited", "near_next").toPandas()
    assert 0.4 < rows["near_edited"].mean() < 0.65 and rows["near_next"].mean() < 0.05


def test_queries_read_awkward_tables(spark, tmp_path):
    path = folder(spark, tmp_path, documents=awkward(spark))
    n = awkward(spark).count()
    for name in ("op2_improbable_digest", "op3_minimax_shards", "op7_simhash_classes", "op8_personal_data", "op9_token_store", "op10_bpe_codec"):
        assert queries.QUERIES[name](spark, path).count() == n, name


def plain_digest(texts):
    """Rarities, chains and likeness, one window and one bit at a time."""

    def level(window):
        total = sum(int(digest._STEP[k]) for n in Counter(window).values() for k in range(1, n + 1))
        top = digest.WINDOW * 5 << 20
        return (top - total) * (digest.LEVELS - 1) // top

    data = [t.encode() for t in texts]
    of = [[level(d[i : i + 32]) for i in range(len(d) - 31)] for d in data]
    counts = Counter(lv for row in of for lv in row)
    order = sorted(range(digest.LEVELS), key=lambda lv: (counts[lv], lv))
    dull = int(digest.DULL / 5 * (digest.LEVELS - 1))
    rank = {lv: digest.LEVELS if lv < dull else i for i, lv in enumerate(order)}

    def mixed(chunk):
        x, m = 0x9E3779B97F4A7C15, (1 << 64) - 1
        for i in range(0, 32, 8):
            x = (x ^ int.from_bytes(chunk[i : i + 8], "little")) * 0xFF51AFD7ED558CCD & m
            x ^= x >> 32
        x = x * 0xC4CEB9FE1A85EC53 & m
        return x ^ (x >> 29)

    chains = []
    for d, row in zip(data, of, strict=True):
        ranks = [rank[lv] for lv in row]
        votes = Counter(min(range(s, s + digest.RUN), key=lambda i: (ranks[i], i)) for s in range(len(row) - digest.RUN + 1))  # noqa: B023
        chosen = sorted(i for i, n in votes.items() if n >= digest.POPULAR and ranks[i] < digest.LEVELS)
        if row and not chosen:
            chosen = [min(range(len(row)), key=lambda i: (ranks[i], i))]  # noqa: B023
        hashes = [mixed(d[i : i + 32]) for i in chosen]
        if d and not row:
            hashes = [(mixed(d.ljust(32, b"\0")) + len(d)) % (1 << 64)]
        filters = []
        for at in range(0, len(hashes), digest.FILTER):
            part = hashes[at : at + digest.FILTER]
            filters.append((len(part), {h >> 11 * k & (digest.BITS - 1) for h in part for k in range(digest.PROBES)}))
        chains.append(filters)
    return chains


def plain_likeness(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    total = 0.0
    for n, x in a:
        best = 0.0
        for _, y in b:
            chance, most = len(x) * len(y) / digest.BITS, min(len(x), len(y))
            best = max(best, min(1.0, max(0.0, (len(x & y) - chance) / max(most - chance, 1e-9))))
        total += n * best
    return total / max(sum(n for n, _ in a), sum(n for n, _ in b))


def test_digests_equal_the_plain_ones(spark, small):
    import pandas as pd

    texts = pd.read_parquet(f"{small}/documents.parquet")["text"].fillna("").str.slice(0, 1500).tolist()[:30]
    texts += ["", "short", "x" * 31, "y" * 32, "z" * 400, "ab" * 200, "".join(chr(33 + i % 90) for i in range(7000)), texts[0] + texts[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    half = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - h] + texts[(i + 1) % len(texts)][:h] for i, (t, h) in enumerate(zip(texts, half, strict=True))]
    rows = sorted(digest.compare(docs, digest.fit(docs)).collect(), key=lambda r: r["doc_id"])
    # the rarities are those of the documents alone
    counted = Counter()
    for t in texts:
        d = t.encode()
        counted.update(int(lv) for lv in digest.levels(np.frombuffer(d, np.uint8)))
    assert (digest.fit(docs) == digest.rarities(np.array([counted[lv] for lv in range(digest.LEVELS)]))).all()
    own = plain_digest(texts)
    bits = lambda chain: "".join(f"{n:02x}" + np.packbits(np.isin(np.arange(digest.BITS), list(x)).astype(np.uint8)).tobytes().hex() for n, x in chain)
    for i, r in enumerate(rows):
        assert r["fingerprint"] == bits(own[i]), texts[i][:60]
        assert r["near_next"] == pytest.approx(plain_likeness(own[i], own[(i + 1) % len(own)]))
        assert r["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
    held = [digest.chain(h) for h in digest.selected([t.encode() for t in texts + edited], digest.fit(docs))]
    for i, r in enumerate(rows):
        assert r["edited_fingerprint"] == digest.text_of(held[len(texts) + i]) and r["near_edited"] == pytest.approx(digest.likeness(held[i], held[len(texts) + i]))


def plain_terms(rows, alpha=1.25, doubt=0.01):
    """Term spans of each row by the formulas as the module states them."""
    import regex

    words = lambda text: set(regex.findall(r"\p{L}{3,}", text.lower()))
    total = len(rows)
    n_t = Counter(t for _, text in rows for t in words(text))
    texts = Counter(text for _, text in rows)
    n_c, k_c, beside, n_ct, k_ct = Counter(), Counter(), Counter(), Counter(), Counter()
    whose = {}
    for text, n in texts.items():
        spans, at, bare = plain_spans(text), 0, ""
        for a, _, b, _ in spans:
            if a >= at:
                bare += text[at:a] + " "
            at = max(at, b)
        said = words(bare + text[at:])
        whose[text] = {(k, text[a:b]) for a, _, b, k in spans}
        for c in whose[text]:
            n_c[c] += n
            k_c[c] += 1
            beside[c] += len(said)
            for t in said:
                n_ct[c, t] += n
                k_ct[c, t] += 1
    flagged = {}
    for (c, t), n in n_ct.items():
        pmi, ic = np.log2(n * total / (n_c[c] * n_t[t])), np.log2(total / n_c[c])
        p, q = n_t[t] / total, k_ct[c, t] / k_c[c]
        bits = 0.0
        if q > p:
            bits = k_c[c] * (q * np.log2(q / p) + ((1 - q) * np.log2((1 - q) / (1 - p)) if q < 1 and p < 1 else 0.0))
        if ic > 0 and pmi >= ic / alpha and bits >= np.log2(beside[c] / doubt):
            flagged.setdefault(c, set()).add(t)
    out = {}
    for i, text in rows:
        named = set().union(*(flagged.get(c, set()) for c in whose[text]))
        base = plain_spans(text)
        found = [m.span() for m in regex.finditer(r"\p{L}+", text) if m.group().lower() in named]
        out[i] = sorted((a, b) for a, b in found if not any(s[0] < b and a < s[2] for s in base))
    return out


def test_terms_follow_from_plain_counts(spark):
    rnd = random.Random(12)
    filler = [f"filler{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    some = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    people = [(f"Name{chr(65 + i)}xyz", f"p{i}@mail{i}.org") for i in range(8)]
    rows = []
    for i in range(3_000):
        text = some(20)
        if i % 40 == 0:
            name, mail = people[i // 40 % 8]
            text = f"{some(5)} {name} wrote, {name.upper()}! {mail} {some(8)} {mail}"  # an entity that is named twice is in one document
        elif i % 97 == 0:
            text = f"{some(4)} 10.{i % 250}.3.4 once{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {some(4)}"
        rows.append((i, text))
    rows += [(9_000 + i, rows[40][1]) for i in range(5)]  # copies are one text and several documents
    spans = {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term") for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_terms(rows)
    assert spans == want and sum(map(len, want.values())) > 100


def test_an_entity_in_a_third_of_the_texts_has_its_own_terms_only(spark, monkeypatch):
    rnd = random.Random(5)
    filler = [f"filler{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    some = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    rows = []
    for i in range(3_000):
        text = some(12)
        if i % 3 == 0:  # one address in a third of the rows, often with one of 26 words that stand beside no other
            text += f" ops@host.org Team{chr(97 + i // 3 % 26)}team {some(3)}"
        elif i % 50 == 1:
            text += f" one@mail{i % 4}.org Teamateam Solo{chr(97 + i % 4)}solo"
        rows.append((i, text))
    want = plain_terms(rows)
    assert sum(map(len, want.values())) > 50
    for carried in (pii.CARRIED, 0):  # broadcast, or by a shuffle
        monkeypatch.setattr(pii, "CARRIED", carried)
        found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term") for r in found} == want


def test_new_words_of_several_texts_go_to_the_library_together():
    coder, calls = store.WordIds(queries.WORD_BPE), []
    coder._learn = lambda words, learn=coder._learn: (calls.append(len(words)), learn(words))
    texts = ["don't. it's, a.b c,, ß? é! 1. 12, x1, _a_, ' 's '", "", " ", "<|endoftext|>", "İ", "aª, º. ²", "Don't; c, C. b" + "b" * 3000 + "!", "a b, c."]
    want = [WORD.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encoded(texts)] == want and len(calls) == 1
    assert [np.frombuffer(coder.encode(t), coder.dtype).tolist() for t in texts] == want and len(calls) == 1
