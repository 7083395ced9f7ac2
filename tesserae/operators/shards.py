"""Greedy shards bounded by bytes and items, in catalog order, named by their content.

Where a shard ends depends on where the one before it ended, so the rule is a
scan; but where a shard ends if it begins at a given row depends on the next few
rows only. So blocks of rows say, each for itself, where the walk leaves them and
after how many shards, for each row at which it may enter. What neighbouring blocks
say makes what they say together, so blocks are composed in a tree, ``FAN`` at a time;
down the same tree goes where the walk enters each; and blocks deal out their shards.
No task sees more than ``FAN`` blocks' numbers.
Bodies stay where they are and meet their shard number afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.scratch import numbered, written

#: Rows whose sizes travel as one row, and blocks that are composed at once.
BLOCK, FAN = 4096, 64


def greedy(sizes, most_bytes: int = vocab.SHARD_BYTES, most_items: int = vocab.SHARD_ITEMS, shard: int = 0, used: int = 0, held: int = 0) -> tuple[list[int], int, int, int]:
    """The shard of each row, and the state after the last."""
    out = []
    for s in sizes:
        if s > most_bytes:
            raise ValueError("a row is larger than a shard")
        if held == most_items or used + s > most_bytes:
            shard, used, held = shard + 1, 0, 0
        out.append(shard)
        used, held = used + s, held + 1
    return out, shard, used, held


def _nexts(sizes: np.ndarray, most_bytes: int, most_items: int) -> np.ndarray:
    """For each row, the row at which the next shard begins if one begins at this."""
    if len(sizes) and sizes.max() > most_bytes:
        raise ValueError("a row is larger than a shard")
    sums = np.concatenate([[0], np.cumsum(sizes)])
    full = np.searchsorted(sums, sums[:-1] + most_bytes, "right") - 1
    return np.minimum(full, np.arange(len(sizes)) + most_items)


def _walks(sizes: np.ndarray, own: int, most_bytes: int, most_items: int) -> tuple[list[int], list[int]]:
    """For each row at which a walk may enter a block of ``own`` rows: the row behind the block at which it leaves, and the shards that begin inside."""
    nexts = _nexts(sizes, most_bytes, most_items).tolist()
    leaves, begun = [0] * (own + 1), [0] * (own + 1)
    for i in range(own - 1, -1, -1):
        if nexts[i] >= own:
            leaves[i], begun[i] = nexts[i] - own, 1
        else:
            leaves[i], begun[i] = leaves[nexts[i]], begun[nexts[i]] + 1
    return leaves, begun


def _step(leaves, begun, at: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where walks that enter a block at these rows leave it, and the shards begun by then."""
    inside = np.minimum(at, len(leaves) - 1)
    return np.asarray(leaves)[inside], shard + np.asarray(begun)[inside]


def _composed(blocks: pd.DataFrame) -> pd.DataFrame:
    """What neighbouring blocks say together."""
    blocks = blocks.sort_values("b")
    at = np.arange(max(map(len, blocks["leaves"])))
    shard = np.zeros(len(at), np.int64)
    for leaves, begun in zip(blocks["leaves"], blocks["begun"], strict=True):
        at, shard = _step(leaves, begun, at, shard)
    return pd.DataFrame({"b": [blocks["g"].iloc[0]], "leaves": [at], "begun": [shard]})


def _spread(blocks: pd.DataFrame) -> pd.DataFrame:
    """Where the walk that enters their parent enters each block."""
    blocks = blocks.sort_values("b")
    at, shard = blocks["entry"].to_numpy()[:1], blocks["shard"].to_numpy()[:1]
    rows = []
    for b, leaves, begun in zip(blocks["b"], blocks["leaves"], blocks["begun"], strict=True):
        rows.append((b, int(at[0]), int(shard[0])))
        at, shard = _step(leaves, begun, at, shard)
    return pd.DataFrame(rows, columns=["b", "entry", "shard"])


def entered(walks: DataFrame) -> DataFrame:
    """b, entry and shard of each block of ``walks`` (b, leaves, begun): the row at which the walk enters it, and the shards before."""
    last = walks.agg(F.max("b").alias("b")).head()["b"]  # one row
    n, tree = 0 if last is None else last + 1, [walks]
    parent = F.expr(f"b div {FAN}").alias("g")
    while n > 1:
        above = tree[-1].select("*", parent).groupBy("g").applyInPandas(_composed, "b long, leaves array<long>, begun array<long>")
        tree.append(written(above, "walks"))
        n = -(-n // FAN)
    at = tree[-1].select("b", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("shard"))
    for below in reversed(tree[:-1]):
        known = at.withColumnRenamed("b", "g")
        at = below.select("*", parent).join(known, "g").groupBy("g").applyInPandas(_spread, "b long, entry long, shard long")
    return at


def assigned(rows: DataFrame, order: str, size: str, most_bytes: int = vocab.SHARD_BYTES, most_items: int = vocab.SHARD_ITEMS) -> DataFrame:
    """order and shard (from 0). ``order`` is a unique number, however its values are spread."""
    if most_items > BLOCK:
        raise ValueError("a shard is larger than a block")
    sizes = rows.select(F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("s"))
    # a block sees the rows behind it that a shard of its own may reach
    home, place = F.floor(F.col("n") / BLOCK), F.col("n") % BLOCK
    seen = numbered(sizes, ["o"], "n").select("o", "s", "n", F.explode(F.when((place < most_items) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))).alias("b"))
    blocks = seen.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("n", "o", "s"))).alias("r")).select("b", F.col("r.o").alias("o"), F.col("r.s").alias("s"))  # BLOCK + most_items rows at most
    blocks = written(blocks, "blocks")

    def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_walks(np.asarray(s, np.int64), min(len(s), BLOCK), most_bytes, most_items) for s in batch["s"]]
            yield pd.DataFrame({"b": batch["b"], "leaves": [x[: most_items + 1] for x, _ in found], "begun": [n[: most_items + 1] for _, n in found]})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for o, s, entry, shard in zip(batch["o"], batch["s"], batch["entry"], batch["shard"], strict=True):
                own, nexts = min(len(s), BLOCK), _nexts(np.asarray(s, np.int64), most_bytes, most_items)
                begins, i = np.zeros(own, np.int64), entry
                while i < own:
                    begins[i] = 1
                    i = int(nexts[i])
                yield pd.DataFrame({"o": np.asarray(o)[:own], "shard": shard - 1 + np.cumsum(begins)})

    found = written(blocks.select("b", "s").mapInPandas(walks, "b long, leaves array<long>, begun array<long>"), "walks")
    return blocks.join(entered(found), "b").select("o", "s", "entry", "shard").mapInPandas(deal, "o long, shard long").withColumnRenamed("o", order)


def manifest(rows: DataFrame, shards: DataFrame, order: str, body: str) -> DataFrame:
    """shard, items, bytes and the SHA-256 of its bodies in order, which names its file."""
    met = rows.join(shards, order)
    kept = met.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct(order, body))).alias("r"))  # bounded by the shard's limits
    return kept.select("shard", F.size("r").cast("long").alias("items"), F.sha2(F.array_join(F.col(f"r.{body}"), "\n"), 256).alias("name"))
