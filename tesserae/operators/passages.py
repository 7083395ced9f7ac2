"""Passages within texts, by runs of words that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as T

#: Runs of passages that go to every task; more of them meet by a shuffle.
CARRIED = 500_000


def shared_runs(passages: DataFrame, key: str, texts: DataFrame, name: str, column: str, width: int, share: float) -> DataFrame:
    """key, name, shared, n: texts that have at least this share of a passage's ``n`` different runs of ``width`` words.

    Runs of texts are held against those of the passages before anything moves, so
    what moves are the runs that are shared, and each is one row a text and passage.
    """
    # an array of one, exploded: else each step of a run would split the text again
    words = lambda df, k: df.select(F.col(k), F.explode(F.array(T.tokens(F.col(column)))).alias("w"))
    said = lambda df, k: words(df, k).select(k, F.explode(T.shingles(F.col("w"), width)).alias("run"))
    runs = said(passages, key).distinct()
    many = runs.count() > CARRIED
    held = runs if many else F.broadcast(runs)  # its size was checked
    met = said(texts, name).join(held, "run").groupBy(key, name, "run").agg(F.count(F.lit(1)).alias("times")).drop("times")
    n = runs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    shared = met.groupBy(key, name).agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(n if many else F.broadcast(n), key).where(F.col("shared") >= F.col("n") * F.lit(share))
