"""Best-fit-decreasing packing of documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so all that best fit needs to know
of a corpus is how many pieces there are of each length: at most ``capacity``
counts, however many documents. The plan is worked out from these on the
driver, with a segment tree over remaining capacities that finds the tightest
open bin in logarithmic time; equal pieces that meet equal bins are placed
together, as a run. A run says which ranks of a length go to which bins, and the
pieces, ranked within their length across the cluster, look up their run.

Defined results: a null or empty text is the end id alone; repeated rows and rows
with a null doc_id are packed once for each row; a text of any length is packed in
whole, in as many pieces as it needs; pieces of one length take the places of that
length in any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm.common import documents, numbered, settle


class OpenBins:
    """Bins by remaining capacity: runs of neighbouring bin numbers at the leaves of a segment tree."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.width)  # whether a node has bins below it
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        node = self.width + room
        self.some[node] = bool(self.runs[room])
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] | self.some[2 * node + 1]

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.runs[room].append((first, n))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].popleft()
        self._mark(room)
        return run

    def tightest(self, size: int) -> int:
        """The least room of an open bin that a piece of this size fits in, or 0."""
        node = self.width + size
        if self.some[node]:
            return size
        while node > 1:  # up to the first ancestor with bins to the right, then down its left edge
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.width
            node //= 2
        return 0


@dataclass(frozen=True)
class Plan:
    """Sorted runs: pieces of ``size`` with rank from ``rank`` on fill bins from ``first`` on, ``each`` to a bin, from ``offset``."""

    size: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of the pieces with these sizes and ranks."""
        run = np.searchsorted((self.size << 44) + self.rank, (size << 44) + rank, "right") - 1
        nth = rank - self.rank[run]
        return self.first[run] + nth // self.each[run], self.offset[run] + nth % self.each[run] * size


def best_fit_decreasing(counts: Mapping[int, int], capacity: int) -> Plan:
    """Best fit, longest pieces first, for ``counts[size]`` pieces of each size from 1 to capacity."""
    open_, runs, bins = OpenBins(capacity), [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = open_.tightest(size)
            if room:
                first, n = open_.take(room)
            else:  # no open bin has room
                room, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            # what is left after a piece is tighter than any other bin, so a bin takes pieces while it can
            each = room // size
            full = min(n, left // each)
            if full:
                runs.append((size, rank, each, first, capacity - room))
                open_.put(room - each * size, first, full)
                left, rank, first, n = left - full * each, rank + full * each, first + full, n - full
            if n and 0 < left < each:
                runs.append((size, rank, each, first, capacity - room))
                open_.put(room - left * size, first, 1)
                left, first, n = 0, first + 1, n - 1
            open_.put(room, first, n)
    size, rank, each, first, offset = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Plan(size, rank, each, first, offset, bins)


#: Beyond these letters the two libraries' character classes may differ, and the tokenizer itself is asked.
PLAIN = re.compile(r"[^\x00-ɏ]")
END_OF_TEXT = "<|endoftext|>"


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _ranked(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def byte_ids(text: str, path: str, ranks: str) -> list[int]:
    """The tokenizer's ids, from the same vocabulary's ranks where both agree by definition."""
    if PLAIN.search(text):
        return _tokenizer(path).encode(text, add_special_tokens=False).ids
    coder = _ranked(ranks)
    return coder.encode(text, allowed_special="all") if END_OF_TEXT in text else coder.encode_ordinary(text)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, ranks: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids; of a longer one, the first piece takes the remainder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = byte_ids(text, path, ranks)
                ids.append(end_id)
                data, n = np.array(ids, "<u4").tobytes(), len(ids)
                at = [0, *range(n % capacity or capacity, n, capacity), n]
                rows += [(doc_id, i, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(at, at[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInPandas(run, PIECES)


def pack(docs: DataFrame, path: str, ranks: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence and its place there."""
    cut = settle(pieces(docs, path, ranks, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = best_fit_decreasing(counts, capacity)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            where, offset = plan.place(batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64))
            yield batch.drop(columns="rank").assign(sequence_id=where, offset=offset)

    ranked = numbered(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", sum(counts.values()))
    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
