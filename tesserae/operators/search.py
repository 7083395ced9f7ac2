"""Ranked full-text search: prefix phrases, BM25 over the whole corpus, facet filters, pages.

A search argument is validated on the driver; everything else is one lazy plan.
``scored`` looks through token arrays without a shuffle of them; ``Index`` keeps
postings sorted by term, so a prefix reads the row groups that may hold it, and a
dictionary of prefixes, so how many documents have one is read and not counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.functions import text as T


class ArgumentError(ValueError):
    """An argument that the caller may be told about."""


ARGUMENTS = {"query": 240, "category": 32, "license": 120, "kind": 20} | dict.fromkeys(vocab.FACETS, 32)


def checked_text(value, name: str, most: int) -> str:
    import unicodedata

    if not isinstance(value, str):
        raise ArgumentError(f"{name}: a string is needed")
    value = unicodedata.normalize("NFC", value).strip()
    if len(value) > most:
        raise ArgumentError(f"{name}: at most {most} characters")
    if any(c < " " for c in value):
        raise ArgumentError(f"{name}: no control characters")
    return value


def checked_number(value, name: str, low: int, high: int) -> int:
    if type(value) is not int or not low <= value <= high:
        raise ArgumentError(f"{name}: a whole number from {low} to {high}")
    return value


def checked(arguments: Mapping) -> dict:
    """Arguments of a search with their defaults; raises ArgumentError."""
    if not isinstance(arguments, Mapping) or arguments.keys() - ARGUMENTS.keys() - {"limit", "offset"}:
        raise ArgumentError("arguments: unknown")
    out = {name: checked_text(arguments.get(name, ""), name, most) for name, most in ARGUMENTS.items()}
    allowed = {"category": vocab.CATEGORIES, "kind": vocab.KINDS} | vocab.FACETS
    for name, values in allowed.items():
        if out[name] and out[name] not in values:
            raise ArgumentError(f"{name}: not in the vocabulary")
    out["limit"] = checked_number(arguments.get("limit", vocab.PAGE_DEFAULT), "limit", 1, vocab.PAGE_MOST)
    out["offset"] = checked_number(arguments.get("offset", 0), "offset", 0, vocab.OFFSET_MOST)
    return out


def phrases(query: str) -> list[list[str]] | None:
    """Each word of a query as index tokens, the last of them a prefix; None if the query has no word."""
    import re

    words = re.findall(r"\w+", query)[: vocab.QUERY_WORDS]
    return [T.index_words(w) for w in words] or None


def occurrences(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase (its last token a prefix) stands in an array of tokens."""
    *exact, prefix = phrase
    if not exact:
        return F.size(F.filter(tokens, lambda t: t.startswith(prefix))).cast("long")
    # the array is only named outside of lambdas: inside, it would be made anew for each place
    here = F.transform(tokens, lambda t: t == exact[0])
    for k, word in enumerate([*exact[1:], None], 2):
        test = (lambda w: lambda a, t: a & (t == w))(word) if word is not None else (lambda a, t: a & t.startswith(prefix))
        here = F.zip_with(here, F.slice(tokens, k, F.greatest(F.size(tokens), F.lit(1))), test)
    return F.size(F.filter(here, lambda yes: F.coalesce(yes, F.lit(False)))).cast("long")


def bm25(tfs: list[Column], ns: list[Column], length: Column, rows: Column, mean: Column) -> Column:
    """The score, smaller for better matches."""
    total = F.lit(0.0)
    for tf, n in zip(tfs, ns, strict=True):
        idf = F.log((rows - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(vocab.IDF_FLOOR)).otherwise(idf)
        total = total + idf * (tf * (vocab.K1 + 1)) / (tf + vocab.K1 * (1 - vocab.B + vocab.B * length / mean))
    return -total


def scored(items: DataFrame, tokens: str, words: list[list[str]]) -> DataFrame:
    """Rows that have every phrase, with their score; corpus figures are of all rows of ``items``."""
    tfs = [f"_tf{i}" for i in range(len(words))]
    # an array of one, exploded: else every expression below would tokenise the text again
    counted = items.withColumn("_tokens", F.explode(F.array(tokens))).withColumn("_length", F.size("_tokens").cast("long"))
    for name, phrase in zip(tfs, words, strict=True):
        # a word that the index splits into nothing matches nothing
        counted = counted.withColumn(name, occurrences(F.col("_tokens"), phrase) if phrase else F.lit(0).cast("long"))
    figures = counted.agg(F.count(F.lit(1)).alias("_rows"), F.avg("_length").alias("_mean"), *(F.count_if(F.col(t) > 0).alias(f"{t}n") for t in tfs))
    hits = counted.where(reduce(lambda a, b: a & b, (F.col(t) > 0 for t in tfs))).crossJoin(F.broadcast(figures))  # one row
    score = bm25([F.col(t) for t in tfs], [F.col(f"{t}n") for t in tfs], F.col("_length"), F.col("_rows"), F.col("_mean"))
    return hits.withColumn("score", score).drop("_tokens", "_length", "_rows", "_mean", *tfs, *(f"{t}n" for t in tfs))


def filtered(items: DataFrame, equal: Mapping[str, str] | None = None, holding: Mapping[str, str] | None = None, any_of: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Equality filters, array facets that must hold a value, and facets of which any value will do; empty ones are no filter."""
    for column, value in (equal or {}).items():
        if value:
            items = items.where(F.col(column) == F.lit(value))
    for column, value in (holding or {}).items():
        if value:
            items = items.where(F.array_contains(column, value))
    for column, values in (any_of or {}).items():
        if values:
            items = items.where(F.arrays_overlap(column, F.array(*(F.lit(v) for v in values))))
    return items


def ordered(items: DataFrame, title: str, key: str, by_score: bool) -> DataFrame:
    return items.orderBy(*([F.col("score")] if by_score else []), T.ascii_lower(F.col(title)), F.col(key))


def page(items: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return items.offset(offset).limit(limit) if offset else items.limit(limit)


#: Longest prefix in the dictionary, in characters. Longer ones, which few documents have, are counted from the postings.
PREFIX_CHARS = 6


def prefix_documents(items: DataFrame, tokens: Column) -> DataFrame:
    """prefix, docs: in how many rows a token starts so, for every prefix of up to PREFIX_CHARS characters.

    A row's prefixes are made distinct within it, so the one shuffle carries counts.
    A row without tokens, or with null for them, counts nowhere.
    """
    own = items.select(F.explode(F.array(F.array_distinct(tokens))).alias("t"))  # an array of one: tokens are made once
    each = F.transform(F.filter("t", lambda t: t != ""), lambda t: F.transform(F.sequence(F.lit(1), F.least(F.char_length(t), F.lit(PREFIX_CHARS))), lambda k: t.substr(F.lit(1), k)))
    return own.select(F.explode(F.array_distinct(F.flatten(each))).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("docs"))


def corpus_figures(lengths: DataFrame) -> DataFrame:
    """One row: how many documents there are, and their mean length."""
    return lengths.agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("mean"))


@dataclass(frozen=True)
class Index:
    """Postings (term, doc, tf, places) sorted by term, documents (doc, length), and what is known beforehand of
    them: documents of each prefix (prefix, docs) and one row of figures (rows, mean). Without these two they are counted."""

    postings: DataFrame
    lengths: DataFrame
    prefixes: DataFrame | None = None
    figures: DataFrame | None = None

    @staticmethod
    def build(items: DataFrame, key: str, tokens: Column) -> Index:
        flat = items.select(F.col(key).alias("doc"), F.posexplode(tokens).alias("place", "term"))
        postings = flat.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("place")).alias("places"))
        return Index(postings, items.select(F.col(key).alias("doc"), F.size(tokens).cast("long").alias("length")))

    def sorted_parts(self) -> dict[str, DataFrame]:
        """The parts that there are, by name, in the order in which they should be written."""
        parts = {"postings": self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc"), "lengths": self.lengths}
        if self.prefixes is not None:
            parts["prefixes"] = self.prefixes.repartitionByRange("prefix").sortWithinPartitions("prefix")
        return parts | ({} if self.figures is None else {"figures": self.figures})

    def with_dictionary(self, items: DataFrame, tokens: Column) -> Index:
        """The same index with the dictionary of prefixes and the figures of ``items``."""
        return replace(self, prefixes=prefix_documents(items, tokens), figures=corpus_figures(self.lengths))

    def write(self, path: str) -> None:
        for name, part in self.sorted_parts().items():
            part.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str, dictionary: bool = False) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", *(("prefixes", "figures") if dictionary else ()))))

    def _having(self, phrase: list[str], name: str) -> DataFrame:
        *exact, prefix = phrase
        if not exact:
            return self.postings.where(F.col("term").startswith(prefix)).groupBy("doc").agg(F.sum("tf").cast("long").alias(name))
        steps = [self.postings.where(F.col("term") == w) for w in exact] + [self.postings.where(F.col("term").startswith(prefix))]
        at = None
        for k, step in enumerate(steps):
            places = step.select("doc", F.explode("places").alias("p")).select("doc", (F.col("p") - k).alias("p")).distinct()
            at = places if at is None else at.join(places, ["doc", "p"])
        return at.groupBy("doc").agg(F.count(F.lit(1)).alias(name))

    def search(self, words: list[list[str]]) -> DataFrame:
        """doc and score of the documents that have every phrase."""
        if not all(words):
            return self.lengths.select("doc", F.lit(0.0).alias("score")).limit(0)
        hits, names = None, [f"tf{i}" for i in range(len(words))]
        figures = corpus_figures(self.lengths) if self.figures is None else self.figures
        for name, phrase in zip(names, words, strict=True):
            one = self._having(phrase, name)
            if self.prefixes is not None and len(phrase) == 1 and len(phrase[0]) <= PREFIX_CHARS:
                n = self.prefixes.where(F.col("prefix") == phrase[0]).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias(f"{name}n"))
            else:
                n = one.agg(F.count(F.lit(1)).alias(f"{name}n"))
            figures = figures.crossJoin(n)  # a row each
            hits = one if hits is None else hits.join(one, "doc")
        rows = hits.join(self.lengths, "doc").crossJoin(F.broadcast(figures))
        return rows.select("doc", bm25([F.col(n) for n in names], [F.col(f"{n}n") for n in names], F.col("length"), F.col("rows"), F.col("mean")).alias("score"))


def containing(items: DataFrame, text: Column, query: str) -> DataFrame:
    """Rows whose text has the query anywhere, whatever its case."""
    return items.where(F.lower(text).contains(query.lower()))


def by_id(items: DataFrame, key, column: str = "id") -> DataFrame:
    """The public row with this id."""
    return items.where((F.col(column) == F.lit(key)) & (F.col("access") == "public")).limit(1)


def exported(items: DataFrame, column: str = "id") -> DataFrame:
    """All public rows in order of their ids."""
    return items.where("access = 'public'").orderBy(column)


def resolved(items: DataFrame, aliases: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (key and more) with the row that each names: an item's own id, or an alias of it, with ``canonical_id`` then.

    An id goes before an alias, aliases never chain, and keys of nothing are left out.
    """
    own = keys.join(items.withColumnRenamed("id", "key"), "key").withColumn("canonical_id", F.lit(None).cast("string"))
    named = keys.join(items.select(F.col("id").alias("key")), "key", "left_anti").join(aliases.select(F.col("alias").alias("key"), F.col("item_id").alias("canonical_id")), "key")
    return own.unionByName(named.join(items.withColumnRenamed("id", "canonical_id"), "canonical_id"))


def resolve(items: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """The row of a key: its own, or that of the entry its alias names, with ``canonical_id`` then. Aliases never chain."""
    own = items.where(F.col("id") == key).withColumn("canonical_id", F.lit(None).cast("string"))
    named = aliases.where(F.col("alias") == key).select(F.col("item_id").alias("id"))
    other = items.join(F.broadcast(named), "id").withColumn("canonical_id", F.col("id"))
    both = own.withColumn("_first", F.lit(0)).unionByName(other.withColumn("_first", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first"))).where("_n = 1").drop("_first", "_n")
