"""Personal data, and the terms that give it away.

Base spans come from patterns with exact rules. A document's other words are the
context of each of them. Over the corpus, a term t that stands in documents with a
protected entity c (the value of a base span) discloses it by its pointwise mutual
information,

    PMI(c; t) = log2( n(c, t) * N / (n(c) * n(t)) )

in documents. What there is to disclose is the entity's information content,
IC(c) = log2(N / n(c)); a term is flagged if PMI(c; t) >= IC(c) / alpha and chance
does not explain that they meet: in k(c, t) of the k(c) different texts with c, where
t is in a share p = n(t) / N of all documents, that has at most the probability

    2 ^ -(k(c) * D(k(c, t) / k(c) || p))    (Chernoff; D in bits)

which must be under ``doubt`` over the number of words that stand beside c. So a
rare word of a large corpus counts beside an entity seen once, in a small corpus it
is no evidence. Copies of a text are one text here. In every document with the
entity whose lower-cased words hold a flagged term, all its places become spans of kind
``term``. Sanitising replaces spans by their kind (a generalisation).

Everything here is DataFrame functions: no Python runs on the executors.

Defined results: a null text is empty and has no spans; a null doc_id is kept;
repeated rows give repeated results; a text of any length is searched in whole; spans
that begin at one place stand in the order of their kinds; an empty table gives no
rows; other columns are ignored by ``find`` and kept by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import documents, forget, settle

KINDS = ("email", "ip", "card", "phone", "term")
#: As the rules have them, but possessive and begun only where a leftmost match can begin, so that no text takes quadratic time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind.
HINTS = {"email": "@", "ip": None, "card": None, "phone": "+"}
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
#: Matches of a text that are placed at once.
BLOCK = 64
#: An entity in over one of so many documents is frequent; there are at most so many for each span of a document.
FREQUENT = 1000
#: Rows of a word or an entity and a number that are broadcast; more are joined by a shuffle, with the same rows.
CARRIED = 500_000


def _valid(kind: str, m: Column) -> Column:
    """Whether a match counts."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        least = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(least(p)) <= 3, F.concat(F.lit("0"), least(p)).cast("int")).otherwise(999) <= 255)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    back = F.split(F.reverse(digits), "")
    each = F.transform(back, lambda d, i: F.when(d == "", F.lit(0)).when(i % 2 == 1, F.translate(d, "0123456789", "0246813579").cast("int")).otherwise(d.cast("int")))
    return F.when(F.length(digits).between(14, 19), F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def _counts_as(kind: str):
    return lambda span: _valid(kind, span["value"])


def _is(kind: str):
    return lambda span: span["kind"] == kind


def located(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of the pattern's matches, leftmost and without overlap: what lies between matches gives their places."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    rank = KINDS.index(kind)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["g"]
        end = start + F.coalesce(F.char_length(p["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), p["m"].alias("value"))
        more = F.when(p["m"].isNotNull(), F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))
        return F.struct(end.alias("at"), F.concat(acc["out"], more).alias("out"))

    def walked(start: Column, some: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(some, begin, step, lambda acc: acc["out"])

    def placed(all_: Column) -> Column:
        """In blocks, each from where those before it end: one long array that grows by single spans would cost its square."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))
        lengths = F.transform(blocks, lambda some: F.aggregate(some, F.lit(0), lambda n, p: n + p["g"] + F.coalesce(F.char_length(p["m"]), F.lit(0))))
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(lengths, nothing, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(starts, blocks, walked))

    # the pairs as an array of one: within its lambda they are a value, and not worked out again for each use
    return F.flatten(F.transform(F.array(pairs), lambda p: F.when(F.size(p) <= BLOCK, walked(F.lit(0), p)).otherwise(placed(p))))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    found = []
    for kind, pattern in PATTERNS.items():
        may = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike(pattern)
        found.append(F.when(may, F.filter(located(text, F.lit(pattern), kind), _counts_as(kind))).otherwise(none))
    return F.array_sort(F.concat(*found))


def described(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0)))


def _carried(df: DataFrame) -> DataFrame:
    """The rows to be broadcast, if they are few; counted first."""
    return F.broadcast(df) if df.count() <= CARRIED else df


def _contexts(texts: DataFrame) -> DataFrame:
    """text_key, n, c (the text's entities, each once) and terms (its words beside them), written."""
    bare = masked(F.col("text"), F.col("spans"), lambda s: F.lit(" "))
    whose = F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    return settle(texts.select("text_key", "n", whose.alias("c"), _words(bare).alias("terms")), "seen")


def disclosing(contexts: DataFrame, docs: DataFrame, alpha: float = 1.25, doubt: float = 0.01) -> DataFrame:
    """kind, value, term, pmi, ic, written: the terms that disclose an entity beyond the threshold.

    ``contexts`` has c, terms and n, the documents of each different text with base spans, ``docs`` all documents.
    """
    total = float(docs.count())
    words = documents(docs).select(F.explode(_words(F.col("text"))).alias("term"))
    counts = settle(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "counts")
    seen = contexts.select("n", F.explode("c").alias("c"), "terms").select("n", "c.*", "terms")
    entities = settle(seen.groupBy("kind", "value").agg(F.sum("n").alias("n_c"), F.count(F.lit(1)).alias("k_c"), F.sum(F.size("terms")).alias("beside")), "entities")

    # PMI >= IC / alpha means n_t <= n_ct * (N / n_c) ** (1 - 1 / alpha), and n_ct is n_c at most: beside
    # entities that are not frequent, common terms never reach it, so they go before anything is dealt out
    def most(n):
        return F.pow(n, F.lit(1 / alpha)) * F.lit(total ** (1 - 1 / alpha) * (1 + 1e-9))

    frequent = entities.where(F.col("n_c") > total / FREQUENT).select("kind", "value", F.col("n_c").alias("often"))
    common = counts.where(F.col("n_t") > total * FREQUENT ** (-1 / alpha) * (1 + 1e-9)).select("term", F.col("n_t").alias("widely"))
    beside = seen.join(_carried(frequent), ["kind", "value"], "left").select("n", "kind", "value", "often", F.explode("terms").alias("term"))
    beside = beside.join(_carried(common), "term", "left").where(F.col("widely").isNull() | (F.col("widely") <= most(F.col("often"))))
    pairs = settle(beside.groupBy("kind", "value", "term").agg(F.sum("n").alias("n_ct"), F.count(F.lit(1)).alias("k_ct")), "pairs")
    rare = settle(pairs.join(counts, "term").where(F.col("n_t") <= most(F.col("n_ct"))), "known")
    known = rare.join(entities, ["kind", "value"])

    pmi = F.log2(F.col("n_ct") * F.lit(total) / (F.col("n_c") * F.col("n_t")))
    ic = F.log2(F.lit(total) / F.col("n_c"))
    p, q = F.col("n_t") / F.lit(total), F.col("k_ct") / F.col("k_c")
    rest = F.when((q < 1) & (p < 1), (1 - q) * F.log2((1 - q) / (1 - p))).otherwise(0.0)
    bits = F.when(q > p, F.col("k_c") * (q * F.log2(q / p) + rest)).otherwise(0.0)
    sure = bits >= F.log2(F.col("beside") / F.lit(doubt))
    found = known.where(sure).select("kind", "value", "term", pmi.alias("pmi"), ic.alias("ic")).where((F.col("ic") > 0) & (F.col("pmi") >= F.col("ic") / alpha))
    flagged = settle(found, "flagged")
    forget(counts, entities, pairs, rare)
    return flagged


def _terms(texts: DataFrame, contexts: DataFrame, flagged: DataFrame) -> DataFrame:
    """text_key and terms (spans) of the texts in which a flagged term stands.

    A text's own words meet its own entities, those of either that are flagged at all, and
    only pairs that are flagged stay: no list is longer than a text, however many terms an entity has.
    """
    said = contexts.select("text_key", F.explode("terms").alias("term")).join(flagged.select("term").distinct(), "term", "left_semi")
    held = contexts.select("text_key", F.explode("c").alias("c")).select("text_key", "c.*").join(flagged.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
    met = said.join(held, "text_key").join(flagged.select("kind", "value", "term"), ["kind", "value", "term"], "left_semi")
    hits = met.groupBy("text_key").agg(F.collect_set("term").alias("said"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("said", "|"), F.lit(r")(?!\p{L})"))
    placed = hits.join(texts, "text_key").select("text_key", "spans", located(F.col("text"), pattern, "term").alias("terms"))
    free = F.filter("terms", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return placed.select("text_key", free.alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of spans) of every document."""
    rows = documents(docs)
    # texts without base spans are not needed again, so they are not kept
    return _found(rows).select("doc_id", F.col("_base").alias("base"), F.col("_all").alias("spans"))


def _found(rows: DataFrame) -> DataFrame:
    spotted = rows.withColumn("_base", base_spans(F.col("text")))
    spotted = spotted.withColumn("_key", F.when(F.size("_base") > 0, F.sha2("text", 256))).withColumn("text", F.when(F.size("_base") > 0, F.col("text")))
    return _completed(settle(spotted, "spotted"), rows)


def _completed(spotted: DataFrame, docs: DataFrame) -> DataFrame:
    some = spotted.where(F.col("_key").isNotNull())
    found = some.select("doc_id", "text", F.col("_base").alias("spans"), F.col("_key").alias("text_key"))
    texts = settle(found.groupBy("text_key").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count(F.lit(1)).alias("n")), "texts")
    contexts = _contexts(texts)
    flagged = disclosing(contexts, docs)
    placed = settle(_terms(texts, contexts, flagged), "terms")
    forget(texts, contexts, flagged)
    terms = placed.withColumnRenamed("text_key", "_key")
    none = F.array().cast(f"array<{SPAN}>")
    more = some.join(terms, "_key", "left").withColumn("_terms", F.coalesce("terms", none)).drop("terms")
    both = more.unionByName(spotted.where(F.col("_key").isNull()).withColumn("_terms", none))
    return both.withColumn("_all", F.array_sort(F.concat("_base", "_terms"))).drop("_key", "_terms")


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all columns and all rows stay."""
    names = docs.columns
    kept = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")
    rows = docs.select(kept).select("_row", F.col("_row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("_row.text").cast("string"), F.lit("")).alias("text"))
    spotted = rows.withColumn("_base", base_spans(F.col("text")))
    spotted = settle(spotted.withColumn("_key", F.when(F.size("_base") > 0, F.sha2("text", 256))), "spotted")
    done = _completed(spotted, spotted.select("doc_id", "text"))
    return done.select(*(F.when(F.size("_all") > 0, masked(F.col("text"), F.col("_all"))).otherwise(F.col("_row.text")).alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names))


def bracketed(span: Column) -> Column:
    return F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))


def masked(text: Column, spans: Column, said=bracketed) -> Column:
    """The text with its spans, in order, replaced; a span within one before it is part of that."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        piece = F.when(fresh, F.concat(gap, said(s))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def counts(found: DataFrame) -> DataFrame:
    """The digest of ``find``: counts by kind, the base spans' hash, all spans."""
    count = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *count, F.sha2(described(F.col("base")), 256).alias("base_sha256"), described(F.col("spans")).alias("spans"))
