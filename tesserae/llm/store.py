"""A content-addressed store of token ids.

A document's id stream is cut where a rolling hash of the last 32 ids says so,
so equal passages give equal chunks wherever they stand. Each distinct chunk is
stored once, under its SHA-256. Under ``path`` lie, as Parquet parts

* ``kind=chunk``: digest, payload (the ids, little-endian, of the width in the manifest)
* ``kind=recipe``: one row for each document, in ascending doc_id order over
  segment and ordinal: its chunks' digests and lengths, its ids and those before
  it in its segment, and the Merkle root of the digests
* ``kind=segment``: one row for each segment: documents, ids, and the Merkle root
  over its recipes (doc_id, ids and root of each)

Both ``catalogue`` and ``read`` check every chunk against its digest, every
length and root against its recipe, and every recipe against its segment's root,
and fail if anything is missing, changed or in another place. The CRC-32 of a
document follows from those of its chunks, so ``catalogue`` moves no payload
between executors; ``read`` does, and returns the ids themselves.

Defined results: a null or empty text is the end id alone; repeated rows are
documents of their own that share all chunks, in any order among each other; a
null doc_id comes first; a very long text has as many chunks as it needs and is
never cut short; an empty table makes an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm.common import bucket, cuts, documents, parts

#: Cut after at least, about and at most so many ids.
LEAST, USUAL, MOST = 128, 512, 4096
#: Runs between white space that a worker keeps with their ids.
MEMO = 1_000_000
#: Letters of texts whose runs are looked up together, about; and signs that often end a run.
TOGETHER, SIGNS = 1 << 20, frozenset(".,;:!?")

PROSE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
UNUSUAL = re.compile(r"[^\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]|<\|")


#: ASCII without the controls that are white space to one library only.
ORDINARY = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F)])


def unusual(text: str) -> bool:
    """Whether a text must go to the library as it is: rare letters, controls, or what may be a special token."""
    if text.isascii():
        return "<|" in text or bool(text.encode("ascii").translate(None, ORDINARY))
    return UNUSUAL.search(text) is not None


class WordIds:
    """The tokenizers library, asked once for each distinct word of ordinary prose and directly for any other text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids of tokens that end a word
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}  # of what stands between white space

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, words: list[str]) -> None:
        ids = self._ids("\n".join(words))
        data, width = ids.tobytes(), self.dtype.itemsize
        ends = [0, *((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()]
        for word, a, b in zip(words, ends[:-1], ends[1:], strict=True):
            self.words[word] = data[a:b]

    def encode(self, text: str) -> bytes:
        return self.encoded([text])[0]

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what is new in about ``TOGETHER`` letters goes to the library at once."""
        out, at = [], 0
        while at < len(texts):
            start, letters = at, 0
            while at < len(texts) and (at == start or letters + len(texts[at]) <= TOGETHER):
                letters += len(texts[at])
                at += 1
            split = [None if unusual(text) else text.lower().split() for text in texts[start:at]]
            self._see(set().union(*(runs for runs in split if runs)))
            known = self.runs.__getitem__
            out += [self._ids(text).tobytes() if runs is None else b"".join(map(known, runs)) for text, runs in zip(texts[start:at], split, strict=True)]
        return out

    def _see(self, runs: set[str]) -> None:
        """Sees to it that the ids of these runs are known."""
        new = runs.difference(self.runs)
        if new and len(self.runs) > MEMO:
            self.runs.clear()
            self.words.clear()
            new = runs
        # letters alone are one word, and most other runs are letters with a sign behind them, of which the pattern makes two
        whole = [run for run in new if run.isalpha()]
        ended = [run for run in new if run[-1] in SIGNS and run[:-1].isalpha()]
        parts = {run: PROSE.findall(run) for run in new.difference(whole, ended)}
        words = {*whole, *(run[:-1] for run in ended), *(run[-1] for run in ended)}.union(*parts.values())
        if unknown := words.difference(self.words):
            self._learn(list(unknown))
        known = self.words.__getitem__
        self.runs.update(zip(whole, map(known, whole), strict=True))
        self.runs.update((run, known(run[:-1]) + known(run[-1])) for run in ended)
        self.runs.update((run, b"".join(map(known, words))) for run, words in parts.items())


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordIds(path)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit value for each id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the runs of 32 ids whose hash marks a cut.

    Streams may lie behind one another: what the hash sees of the stream before is
    only within the first ``LEAST`` ids, where nothing is cut.
    """
    h = _mixed(ids)
    for k in (1, 2, 4, 8, 16):  # h[i] becomes the sum of the last 2k mixed ids, each shifted by its age
        h[k:] += h[:-k] << np.uint64(k)
    return np.flatnonzero(h >> np.uint64(32) & np.uint64(USUAL - 1) == 0) + 1


def _ends(found: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of the stream from start to stop, from the marks within it."""
    out = []
    for m in (*found, stop):
        while m - start > MOST:
            start += MOST
            out.append(start)
        if m - start >= LEAST or m == stop:
            if m > start:
                out.append(m)
            start = m
    return out


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream; the last is its length."""
    return _ends(marks(ids).tolist(), 0, len(ids))


class Tree:
    """The root of a binary hash tree over leaves that come one by one; an odd last node moves up as it is.

    Only the roots of whole subtrees are held, one for each bit of the number of leaves.
    """

    def __init__(self) -> None:
        self.n, self.peaks = 0, []

    def add(self, leaf: bytes) -> None:
        n = self.n
        while n & 1:
            leaf = hashlib.sha256(b"\x01" + self.peaks.pop() + leaf).digest()
            n >>= 1
        self.peaks.append(leaf)
        self.n += 1

    def root(self) -> bytes:
        if not self.peaks:
            return hashlib.sha256(b"").digest()
        out = self.peaks[-1]
        for peak in reversed(self.peaks[:-1]):
            out = hashlib.sha256(b"\x01" + peak + out).digest()
        return out


def merkle(leaves: list[bytes]) -> bytes:
    if len(leaves) == 1:
        return leaves[0]
    tree = Tree()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def _split(digests: bytes) -> list[bytes]:
    return [digests[i : i + 32] for i in range(0, len(digests), 32)]


def _leaf(doc_id: int | None, n_ids: int, root: bytes) -> bytes:
    """What a recipe is to its segment's tree."""
    return hashlib.sha256(b"\x00%d,%d," % (n_ids, doc_id) + root if doc_id is not None else b"\x00%d,," % n_ids + root).digest()


SCHEMA = pa.schema(
    [("kind", pa.string()), ("doc_id", pa.int64()), ("segment", pa.int32()), ("ordinal", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64())]
    + [(name, pa.binary()) for name in ("digests", "lengths", "root", "digest", "payload")]
    + [("width", pa.int32())]
)
COLUMNS = "kind string, doc_id long, segment int, ordinal long, before long, n_ids long, digests binary, lengths binary, root binary, digest binary, payload binary, width int"


def _batch(n: int, **columns) -> pa.RecordBatch:
    """A batch of n rows with these columns (lists, or one value for all rows); the others are null."""
    arrays = []
    for field in SCHEMA:
        x = columns.get(field.name)
        arrays.append(pa.nulls(n, field.type) if x is None else pa.array(x if isinstance(x, list) else [x] * n, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes the documents and writes the store.

    One exchange takes recipes to their segment and chunks to the task of their
    digest. A task sends a chunk once, so a passage that a third of all
    documents share arrives as often as there are tasks, not documents.
    """
    rows = documents(docs)
    n = parts(docs.sparkSession)
    at = cuts(rows, "doc_id", n)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sent = word_ids(tokenizer), set()
        end, dtype, width = np.array([end_id], coder.dtype).tobytes(), coder.dtype, coder.dtype.itemsize
        sha256, add = hashlib.sha256, sent.add
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                payloads, names, n_ids, digests, lengths, roots = [], [], [], [], [], []
                streams = [ids + end for ids in coder.encoded(batch.column("text").to_pylist())]
                data = b"".join(streams)
                cuts_at = marks(np.frombuffer(data, dtype))
                stops = np.cumsum([len(s) // width for s in streams])
                owned = np.split(cuts_at, np.searchsorted(cuts_at, stops[:-1], "right"))
                start = 0
                for stop, found in zip(stops.tolist(), owned, strict=True):
                    own, sizes, a = [], array("I"), start
                    for b in _ends(found.tolist(), start, stop):
                        payload = data[a * width : b * width]
                        digest = sha256(payload).digest()
                        own.append(digest)
                        sizes.append(b - a)
                        if digest not in sent:
                            if len(sent) > 200_000:
                                sent.clear()
                            add(digest)
                            names.append(digest)
                            payloads.append(payload)
                        a = b
                    n_ids.append(stop - start)
                    digests.append(b"".join(own))
                    roots.append(merkle(own))
                    lengths.append(sizes.tobytes())
                    start = stop
                places = [int.from_bytes(x[:3], "big") for x in names]
                yield _batch(len(names), kind="chunk", segment=places, digest=names, payload=payloads, width=width)
                ids, segments = batch.column("doc_id").to_pylist(), batch.column("segment").to_pylist()
                yield _batch(len(ids), kind="recipe", doc_id=ids, segment=segments, n_ids=n_ids, digests=digests, lengths=lengths, root=roots, width=width)

    def sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, segment, ordinal, before, tree = None, None, 0, 0, Tree()

        def seal() -> pa.RecordBatch:
            return _batch(1, kind="segment", segment=segment, ordinal=ordinal, n_ids=before, root=[tree.root()])

        for batch in batches:  # sorted: first chunks by digest, then recipes by segment and doc_id
            n = sum(x == "chunk" for x in batch.column("kind").to_pylist())
            if n:
                names = batch.column("digest").slice(0, n).to_pylist()
                new = [a != b for a, b in zip(names, [last, *names], strict=False)]
                last = names[-1]
                yield batch.slice(0, n).filter(pa.array(new))
            if n == batch.num_rows:
                continue
            rows = batch.slice(n)
            ordinals, befores = [], []
            done = 0
            for at, doc_id, root, n_ids in zip(*(rows.column(c).to_pylist() for c in ("segment", "doc_id", "root", "n_ids")), strict=True):
                if at != segment:
                    if segment is not None:
                        yield _numbered(rows.slice(done, len(ordinals)), ordinals, befores)
                        yield seal()
                        done, ordinals, befores = done + len(ordinals), [], []
                    segment, ordinal, before, tree = at, 0, 0, Tree()
                ordinals.append(ordinal)
                befores.append(before)
                tree.add(_leaf(doc_id, n_ids, root))
                ordinal, before = ordinal + 1, before + n_ids
            yield _numbered(rows.slice(done, len(ordinals)), ordinals, befores)
        if segment is not None:
            yield seal()

    (
        rows.withColumn("segment", bucket("doc_id", at))
        .mapInArrow(chunked, COLUMNS)
        .repartitionById(n, F.col("segment"))
        .sortWithinPartitions("kind", "digest", "segment", "doc_id", "digests")
        .mapInArrow(sealed, COLUMNS)
        .write.partitionBy("kind")
        .parquet(path)
    )


def _numbered(rows: pa.RecordBatch, ordinals: list[int], befores: list[int]) -> pa.RecordBatch:
    arrays = list(rows.columns)
    arrays[SCHEMA.get_field_index("ordinal")] = pa.array(ordinals, pa.int64())
    arrays[SCHEMA.get_field_index("before")] = pa.array(befores, pa.int64())
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, SCHEMA, strict=True)], schema=SCHEMA)


#: CRC-32's polynomial, bit-reversed.
POLYNOMIAL = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo CRC-32's, bit-reversed."""
    out = np.zeros_like(a)
    one = np.uint64(1)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(k) & one, b, np.uint64(0))
        b = np.where(b & one, b >> one ^ POLYNOMIAL, b >> one)
    return out


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    """x to the power of 8 * 2**k, for each bit k of a length in bytes."""
    x = np.array([1 << 30], np.uint64)
    for _ in range(3):
        x = _times(x, x)
    out = [x]
    for _ in range(47):
        out.append(_times(out[-1], out[-1]))
    return out


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What CRC-32 values add to that of a text in which n bytes follow."""
    crc, n = crc.astype(np.uint64), n.astype(np.uint64)
    for k, power in enumerate(_powers()):
        hit = n >> np.uint64(k) & np.uint64(1) == 1
        if hit.any():
            crc[hit] = _times(crc[hit], np.broadcast_to(power, (int(hit.sum()),)).copy())
        if not (n >> np.uint64(k + 1)).any():
            break
    return crc


def _part(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(COLUMNS).parquet(path).where(F.col("kind") == kind)


def _chunk_sums(chunks: DataFrame) -> DataFrame:
    """digest, n, crc of each stored chunk, after a check of its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, crc = [], []
            for digest, payload, width in zip(batch["digest"], batch["payload"], batch["width"], strict=True):
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = np.frombuffer(payload, f"<u{width}").astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
            yield pd.DataFrame({"digest": batch["digest"], "n": n, "crc": crc})

    return chunks.select("digest", "payload", "width").mapInPandas(run, "digest binary, n long, crc long")


def _steps(recipes: DataFrame) -> DataFrame:
    """One row for each chunk of each document, with the bytes of ids (as 32 bits) that follow it; recipes are checked against their roots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count = [len(x) // 4 for x in batch["lengths"]]
            lengths = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch["lengths"]]
            names = [_split(x) for x in batch["digests"]]
            for own, sizes, root, n_ids in zip(names, lengths, batch["root"], batch["n_ids"], strict=True):
                if len(own) != len(sizes) or sizes.sum() != n_ids or merkle(own) != root:
                    raise ValueError("a recipe does not agree with its root or its length")
            after = [4 * (x.sum() - np.cumsum(x)) for x in lengths]
            flat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
            yield pd.DataFrame(
                {"segment": np.repeat(batch["segment"], count), "ordinal": np.repeat(batch["ordinal"], count), "seq": flat([np.arange(c) for c in count]), "digest": [d for own in names for d in own], "length": flat(lengths), "after": flat(after)}
            )

    return recipes.select("segment", "ordinal", "n_ids", "digests", "lengths", "root").mapInPandas(run, "segment int, ordinal long, seq long, digest binary, length long, after long")


def _seals(recipes: DataFrame) -> DataFrame:
    """segment, documents, ids and root as they follow from the recipes; rows stream by in order, none are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, before, tree, sound = None, 0, Tree(), True

        def seal() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "documents": pa.array([tree.n], pa.int64()), "ids": pa.array([before], pa.int64()), "found": pa.array([tree.root() if sound else None], pa.binary())})

        for batch in batches:
            for at, doc_id, ordinal, start, n_ids, root in zip(*(batch.column(c).to_pylist() for c in ("segment", "doc_id", "ordinal", "before", "n_ids", "root")), strict=True):
                if at != segment:
                    if segment is not None:
                        yield seal()
                    segment, before, tree, sound = at, 0, Tree(), True
                sound &= ordinal == tree.n and start == before
                tree.add(_leaf(doc_id, n_ids, root or b""))
                before += n_ids
        if segment is not None:
            yield seal()

    rows = recipes.select("segment", "doc_id", "ordinal", "before", "n_ids", "root").repartition("segment").sortWithinPartitions("segment", "ordinal")
    return rows.mapInArrow(run, "segment int, documents long, ids long, found binary")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """The segments whose figures or Merkle root do not follow from their recipes; none if all recipes are whole."""
    return _checked(spark, path).where(~F.col("sound")).select("segment", "root", "found")


def _checked(spark: SparkSession, path: str) -> DataFrame:
    want = _part(spark, path, "segment").select("segment", "ordinal", "n_ids", "root")
    both = want.join(_seals(_part(spark, path, "recipe")), "segment", "full")
    same = (F.col("root") == F.col("found")) & (F.col("ordinal") == F.col("documents")) & (F.col("n_ids") == F.col("ids"))
    return both.withColumn("sound", F.coalesce(same, F.lit(False)))


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """segment and the ids before it, after a check of every segment's root; a row for each segment."""
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    n_ids = F.when(F.col("sound"), F.col("n_ids")).otherwise(F.raise_error(F.lit("a segment does not agree with its root")).cast("long"))
    sure = _checked(spark, path).select("segment", n_ids.alias("n_ids"))
    return F.broadcast(sure.select("segment", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).where("n_ids is not null"))  # as many rows as there were partitions


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    recipes = _part(spark, path, "recipe")
    chunks = _chunk_sums(_part(spark, path, "chunk")).withColumnRenamed("digest", "stored")

    @F.pandas_udf("long")
    def following(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(moved(crc.to_numpy(np.int64), after.to_numpy(np.int64)).astype(np.int64))

    steps = _steps(recipes)
    found = steps.join(chunks, steps["digest"] == chunks["stored"], "left")
    sums = found.select("segment", "ordinal", _whole(F.col("n")).alias("n"), following("crc", "after").alias("part")).groupBy("segment", "ordinal").agg(F.sum("n").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"))
    return (
        recipes.select("doc_id", "segment", "ordinal", "before")
        .join(sums, ["segment", "ordinal"])
        .join(_bases(spark, path), "segment")
        .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )


def _whole(n: Column) -> Column:
    """The ids of a chunk, which must be as many as its recipe says."""
    return F.when(n == F.col("length"), n).otherwise(F.raise_error(F.lit("a chunk is missing or has another length")).cast("long"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every document, put together from its chunks; all checks of ``catalogue`` hold here, too."""
    recipes = _part(spark, path, "recipe")
    chunks = _part(spark, path, "chunk").select(F.col("digest").alias("stored"), "payload", "width")
    steps = _steps(recipes)

    @F.pandas_udf("array<int>")
    def joined(payloads: pd.Series, digests: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for own, names, width in zip(payloads, digests, widths, strict=True):
            for payload, name in zip(own, _split(names), strict=True):
                if hashlib.sha256(payload).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
            out.append(np.frombuffer(b"".join(own), f"<u{width}").astype(np.int32))
        return pd.Series(out)

    n = F.octet_length("payload") / F.col("width")
    found = steps.join(chunks, steps["digest"] == chunks["stored"], "left").select("segment", "ordinal", "seq", "payload", "width", _whole(n).alias("n"))
    whole = found.groupBy("segment", "ordinal").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("c"), F.first("width").alias("w"), F.sum("n").alias("n"))  # one document's chunks
    rows = recipes.select("doc_id", "segment", "ordinal", "digests").join(whole, ["segment", "ordinal"]).join(_bases(spark, path).select("segment", "base"), "segment")
    return rows.where("n > 0 and base >= 0").select("doc_id", joined("c.payload", "digests", "w").alias("ids"))
