"""Exact top-k inner products by a vector-approximation file.

Equal vectors are one entry, with the least of their ids, so it makes no
difference how many copies of a vector there are. Two tables are written: the
approximations, one byte for each component (the cell of a grid that the component
lies in), and the exact vectors. Queries with equal vectors are one class.

A block of classes is sent to all tasks, which scan the approximations only: from
a cell's bounds follow a lower and an upper bound of the score, and the least of
the greatest lower bounds is a threshold that no vector of the answer stays below.
What reaches it goes on, for all blocks, to the exact vectors, which are read by
key and best bound first: a first look takes as many as an answer has, its worst
score is a new threshold, and a second look takes what still reaches that. Nothing
else of the exact table leaves its join.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, as queries or candidates; scores exist between vectors
of one length only, of any length; a repeated id is asked for once, with the least
of its vectors, and none of its rows is a candidate for it, but all are for others;
equal scores stand by smaller id; a null id takes no part; an empty table gives no
rows; components and scores beyond a long count as the greatest or least long;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import folder, only, settle

#: Cells of a component: one byte.
CELLS = 256
#: Classes of queries that are bounded in one pass, and candidates in one step.
QUERIES, STEP = 1024, 1024
#: Candidates that a task holds before it passes them on.
HELD = 200_000
SCALE = 1024


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, x (array<bigint>): floor(scale * component) of the usable vectors."""
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = only(vectors, id="vec_id", v="embedding").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


class Grid:
    """Cells of equal width over each component's range, and what a cell says of a score."""

    def __init__(self, low: list[int], high: list[int]):
        self.wide = len(low) * max(max(map(abs, low)), max(map(abs, high))) ** 2 >= 1 << 62
        kind = float if self.wide else np.int64
        self.width = np.array([max(1, -(-(b - a + 1) // CELLS)) for a, b in zip(low, high, strict=True)], kind)
        self.low, self.high = np.array(low, kind), np.array(high, kind)
        self.size = np.maximum(np.abs(self.low), np.abs(self.high)).astype(float)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.low) // self.width, 0, CELLS - 1).astype(np.uint8)

    def bounds(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each candidate's score with each query."""
        least = self.low + cells * self.width.astype(float)
        most = np.minimum(least + self.width - (not self.wide), self.high)
        up, down = np.maximum(queries, 0).astype(float).T, np.minimum(queries, 0).astype(float).T
        slack = 1e-9 * (self.size @ (up - down))  # for rounding
        return least @ up + most @ down - slack, most @ up + least @ down + slack


def entries(rows: DataFrame, k: int) -> DataFrame:
    """key, x and ids of each different vector of ``rows`` (id, key, x): the k + 1 least ids, with the number of their rows (k at most).

    That is as many as an answer can take, whichever one id is left out.
    """
    named = rows.groupBy("key", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("m"))
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    ids = first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "m"))).alias("ids"))  # k + 1 at most
    return rows.groupBy("key").agg(F.first("x").alias("x")).join(ids, "key")


def approximations(vectors: DataFrame, grid: Grid, dim: int) -> DataFrame:
    """key, lone (the vector's id, if it has but one) and cells of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = grid.cells(_matrix(batch.column("x"), dim))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lone"), pa.array([c.tobytes() for c in cells], pa.binary())], names=["key", "lone", "cells"])

    lone = F.when(F.size("ids") == 1, F.col("ids")[0]["id"])
    return settle(vectors.select("key", lone.alias("lone"), "x").mapInArrow(run, "key binary, lone long, cells binary"), "cells")


def bounded(cells: DataFrame, grid: Grid, names: list[bytes], own: list[int | None], queries: np.ndarray, k: int) -> DataFrame:
    """class, key, low, high: of each partition, the candidates that its own lower bounds do not rule out.

    ``own`` is the id whose lone vectors are no candidates, for classes that have one.
    """
    dim, depth = queries.shape[1], k + 1
    alone, mine = np.array([o is not None for o in own]), np.array([o or 0 for o in own], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(names), depth), -np.inf)
        held: list[tuple] = []

        def sifted() -> tuple:
            q, key, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            keep = high >= best[q, 0]
            return q[keep], key[keep], low[keep], high[keep]

        def out() -> pa.RecordBatch:
            q, key, low, high = held[0]
            return pa.RecordBatch.from_pydict({"class": pa.array([names[i] for i in q.tolist()], pa.binary()), "key": pa.array(key.tolist(), pa.binary()), "low": pa.array(low), "high": pa.array(high)})

        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                found = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(-1, dim)
                low, high = grid.bounds(found, queries)
                lone = batch.column("lone")
                hidden = (lone.fill_null(0).to_numpy()[:, None] == mine) & alone & lone.is_valid().to_numpy(zero_copy_only=False)[:, None]
                low[hidden] = high[hidden] = -np.inf
                best = np.sort(np.partition(np.concatenate([best, low.T], axis=1), -depth, axis=1)[:, -depth:], axis=1)
                row, q = np.nonzero((high >= best[:, 0]) & (high > -np.inf))
                keys = np.array(batch.column("key").to_pylist(), object)
                held.append((q, keys[row], low[row, q], high[row, q]))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [sifted()]
                    if len(held[0][0]) > HELD // 2:
                        yield out()
                        held = []
        if held:
            held = [sifted()]
            yield out()

    return cells.mapInArrow(run, "class binary, key binary, low double, high double")


def survivors(cells: DataFrame, classes: DataFrame, grid: Grid, k: int) -> DataFrame:
    """class, key, high: the candidates whose upper bound reaches the k + 1st greatest lower bound of their class."""
    spark, path = cells.sparkSession, folder(cells.sparkSession, "bounds")
    blocks = max(1, -(-classes.count() // QUERIES))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(2 * blocks if blocks > 1 else 1)))
    for b in sorted(r["block"] for r in dealt.select("block").distinct().collect()):
        block = dealt.where(F.col("block") == b).collect()  # about QUERIES rows at most
        at = np.array([r["x"] for r in block], np.int64)
        found = bounded(cells, grid, [bytes(r["class"]) for r in block], [r["own"] for r in block], at, k)
        found.write.mode("append").parquet(path)
    found = spark.read.schema("class binary, key binary, low double, high double").parquet(path)
    nth = found.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("low")))).where(F.col("n") <= k + 1)
    need = nth.where(F.col("n") == k + 1).select("class", F.col("low").alias("need"))
    return found.join(need, "class", "left").where(F.col("need").isNull() | (F.col("high") >= F.col("need"))).select("class", "key", "high")


def _score(wide: bool) -> Column:
    """The inner product of x and q."""
    zero = F.lit(0).cast("long")
    if not wide:
        return F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), zero, lambda s, x: s + x)
    exact = F.aggregate(F.zip_with("x", "q", lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(19,0)")), F.lit(0).cast("decimal(38,0)"), lambda s, x: F.try_add(s, x).cast("decimal(38,0)"))
    rough = F.aggregate(F.zip_with("x", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    top, bottom = F.lit((1 << 63) - 1).cast("decimal(38,0)"), F.lit(-(1 << 63)).cast("decimal(38,0)")
    return F.greatest(bottom, F.least(top, F.coalesce(exact, F.when(rough > 0, top).otherwise(bottom)))).cast("long")


def answers(left: DataFrame, vectors: DataFrame, classes: DataFrame, wide: bool, k: int) -> DataFrame:
    """class, id, m, score: of each class the best entries, one more than an answer has."""
    order = Window.partitionBy("class").orderBy(F.desc("high"), "key")
    ranked = settle(left.withColumn("n", F.row_number().over(order)), "ranked")

    def read(some: DataFrame) -> DataFrame:
        both = some.select("class", "key").join(vectors, "key").join(classes.select("class", "own", F.col("x").alias("q")), "class")
        return both.select("class", "own", _score(wide).alias("score"), "ids")

    first = settle(read(ranked.where(F.col("n") <= k + 1)), "first")
    worst = first.groupBy("class").agg(F.min("score").alias("worst"))
    second = read(ranked.where(F.col("n") > k + 1).join(worst, "class").where(F.col("high") >= F.col("worst")))
    each = first.unionByName(second).select("class", "own", "score", F.explode("ids").alias("e")).select("class", "score", "e.id", "e.m", "own").where(F.col("own").isNull() | (F.col("own") != F.col("id")))
    place = Window.partitionBy("class").orderBy(F.desc("score"), "id")
    return each.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1).select("class", "id", "m", "score")


def search(vectors: DataFrame, queries, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest scores of every query row.

    ``queries`` is a predicate over ``id``.
    """
    digest = F.unhex(F.sha2(F.array_join(F.transform("x", lambda c: c.cast("string")), ","), 256))
    rows = settle(integers(vectors, scale).withColumn("key", digest), "vectors")
    spark, found = vectors.sparkSession, []
    for dim in sorted(r["n"] for r in rows.groupBy(F.size("x").alias("n")).count().collect()):
        own = rows.where(F.size("x") == dim)
        spread = own.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.min("c").alias("low"), F.max("c").alias("high")).orderBy("i").collect()  # one row a component
        grid = Grid([r["low"] for r in spread], [r["high"] for r in spread])
        # an id of several rows is a class of its own, as more than one vector may be its own
        asked = own.where(queries).groupBy("id").agg(F.min(F.struct("x", "key")).alias("v"), F.count(F.lit(1)).alias("n")).select("id", "v.*", F.when(F.col("n") > 1, F.col("id")).alias("own"))
        name = F.when(F.col("own").isNull(), F.col("key")).otherwise(F.concat("key", F.encode(F.col("own").cast("string"), "utf-8")))
        asked = settle(asked.withColumn("class", name), "asked")
        classes = settle(asked.groupBy("class").agg(F.first("own").alias("own"), F.first("x").alias("x"), F.count(F.lit(1)).alias("n"), F.min("id").alias("id")), "classes")
        # a class of one query hides its lone vector, too
        hiding = classes.select("class", F.when(F.col("n") == 1, F.col("id")).alias("own"), "x")
        exact = settle(entries(own, k), "exact")
        if asked.isEmpty():
            continue
        left = survivors(approximations(exact, grid, dim), hiding, grid, k)
        found.append(asked.select("class", F.col("id").alias("query_id")).join(answers(left, exact, hiding, grid.wide, k), "class").where(F.col("id") != F.col("query_id")))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    each = every.select("query_id", F.col("id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("copy"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
