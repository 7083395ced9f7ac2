"""Search, lookup and export over ``documents`` (lang: category, source: source name, labels: facets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.functions import sql
from tesserae.functions import text as T
from tesserae.operators import search as S
from tesserae.scratch import written
from tesserae.session import table

WORDS, OTHER, PHRASE = "th er", "the", "of th"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    facets = labels.select("doc_id", F.array(F.concat(F.lit("quality:"), "quality"), F.concat(F.lit("toxic:"), "toxic")).alias("facets"))
    rows = docs.select("doc_id", "lang", "source", F.substring("text", 1, 60).alias("title"), T.plain_fold(F.lower("text")).alias("folded"))
    return rows.withColumn("tokens", T.tokens(F.col("folded"))).drop("folded").join(facets, "doc_id", "left")


def _tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and tokens alone: an index needs no facets, and token arrays pass no join for them."""
    return _tokens_of(table(spark, sf_dir, "documents"))


def _tokens_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array(T.tokens(T.plain_fold(F.lower("text"))))).alias("tokens"))  # made once


def _ranked(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return S.scored(_items(spark, sf_dir), "tokens", S.phrases(query))


def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.filtered(_ranked(spark, sf_dir, WORDS), {"lang": "en"})
    return S.page(S.ordered(hits.withColumn("score", F.round("score", 6)), "title", "doc_id", True), 10).select("doc_id", "title", "score")


def search_filter_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.filtered(_ranked(spark, sf_dir, OTHER), {"source": "src3"}, any_of={"facets": ["quality:1", "toxic:1"]})
    return hits.select("doc_id", "source", F.round("score", 6).alias("score"))


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"))
    return S.page(S.ordered(items, "title", "doc_id", False), 24, 48).select("doc_id", "title")


def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _ranked(spark, sf_dir, WORDS)
    return hits.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))


def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    hits = S.scored(items, "tokens", [PHRASE.split()])
    return hits.select("doc_id", F.round("score", 6).alias("score"))


def search_no_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without words finds nothing; one with a word the index splits into nothing neither; others what has all their words."""
    items = _items(spark, sf_dir)
    found = []
    for query in ("... !!", "the _", "the"):
        words = S.phrases(query)
        hits = items.limit(0) if words is None else S.scored(items, "tokens", words)
        found.append(hits.agg(F.count(F.lit(1)).alias("total")).select(F.lit(query).alias("query"), "total"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking from an inverted index. Its tokens are written: each word, its count and the lengths read them."""
    index = S.Index.build(written(_tokenised(spark, sf_dir), "tokens"), "doc_id", F.col("tokens"))
    return index.search(S.phrases(WORDS)).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are dealt by document: then its postings meet where its tokens are made, and no occurrence is shuffled
    dealt = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    index = S.Index.build(_tokens_of(dealt), "doc_id", F.col("tokens"))
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences")).where("docs >= 3")


def prefix_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents a word starts so, for every prefix of any word."""
    return S.prefix_documents(_tokenised(spark, sf_dir), F.col("tokens"))


def search_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking from an index that is published first: sorted postings, lengths, the dictionary of prefixes, figures."""
    items = written(_tokenised(spark, sf_dir), "tokens")  # lengths, postings and prefixes are made of them
    lengths = written(S.Index.build(items, "doc_id", F.col("tokens")).lengths, "lengths")
    # dealt by document: then the postings of a document meet where its tokens are, and no occurrence is shuffled
    index = S.Index.build(items.repartition("doc_id"), "doc_id", F.col("tokens"))
    # written before they are sorted: the ranges of terms are cut by a sample, for which all postings would be made once more
    postings = written(index.postings, "postings-by-document")
    parts = S.Index(postings, lengths, S.prefix_documents(items, F.col("tokens")), S.corpus_figures(lengths)).sorted_parts()
    published = S.Index(**{name: part if name == "lengths" else written(part, name) for name, part in parts.items()})
    return published.search(S.phrases(WORDS)).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def lateral_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as SQL makes it: the table function of tokens beside each document, and figures of each term.

    Texts lose their marks before they are dealt by document, as what follows Python has no known place any more;
    then the documents of a term are told apart where their tokens are made, and no occurrence is shuffled.
    """
    sql.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("lateral_documents")
    return spark.sql("""
        with dealt as (select /*+ repartition(doc_id) */ doc_id, unmarked(text) as text from lateral_documents)
        select t.term, count(distinct d.doc_id) as docs, count(*) as occurrences, max(t.pos) + 1 as furthest
        from dealt d, lateral plain_tokens(d.text) t group by t.term""").select("term", "docs", "occurrences", F.col("furthest").cast("long").alias("furthest"))


def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    entry = F.concat_ws(" ", "text", "source", "lang")
    return S.containing(docs, entry, "thing A").select("doc_id", F.length(entry).cast("long").alias("chars"))


def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("access", F.lit("public"))
    return S.by_id(docs, 42, "doc_id").select("doc_id", "lang", "source", F.sha2("text", 256).alias("digest"))


def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turn 0 is the entry; its later turns are aliases of it."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "turn", "role", F.length("text").cast("long").alias("chars"), F.concat(F.col("conv_id").cast("string"), F.lit(":0")).alias("item_id"))
    entries, aliases = rows.where("turn = 0").select("id", "role"), rows.where("turn > 0").select(F.col("id").alias("alias"), "item_id")
    found = S.resolved(entries, aliases, rows.select(F.col("id").alias("key"), "chars")).where("canonical_id is not null")
    return found.select(F.col("key").alias("id"), "canonical_id", F.col("role").alias("parent_role"), "chars")


def export_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.exported(table(spark, sf_dir, "documents").withColumn("access", F.when(F.col("lang") == "de", "public").otherwise("private")), "doc_id")
    return rows.select("doc_id", "source", F.to_json(F.struct("lang", "source")).alias("cell"))


def csv_formula_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.element_at(F.array(*(F.lit(s) for s in ("=", " +", "-", "\t@", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    cell = F.concat(sign, "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.formula_guarded(cell).alias("cell"))


def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed text of a conversation: all turns' texts, joined and capped."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.sha2(T.capped(F.col("t.text"), vocab.INDEX_CHARS), 256).alias("digest"))


TOKENS = """
with items as (
  select doc_id, lang, source, text[1:60] as title,
         regexp_extract_all(translate(lower(text), 'àáâäãåçèéêëìíîïñòóôöõùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '([\\p{L}\\p{N}]+)') as tokens
  from documents),
flat as (select doc_id, unnest(tokens) as term, generate_subscripts(tokens, 1) as place from items),
figures as (select count(*) as n, avg(len(tokens)) as mean from items)
"""


def _score(tf: str, n: str) -> str:
    idf = f"case when ln((f.n - {n} + 0.5) / ({n} + 0.5)) <= 0 then 1e-6 else ln((f.n - {n} + 0.5) / ({n} + 0.5)) end"
    return f"({idf}) * ({tf} * 2.2) / ({tf} + 1.2 * (0.25 + 0.75 * len(i.tokens) / f.mean))"


TWO = f"""{TOKENS},
a as (select doc_id, count(*) as tf from flat where starts_with(term, 'th') group by 1),
b as (select doc_id, count(*) as tf from flat where starts_with(term, 'er') group by 1),
hits as (
  select i.doc_id, i.lang, i.title, round(-({_score("a.tf", "(select count(*) from a)")} + {_score("b.tf", "(select count(*) from b)")}), 6) as score
  from items i join a using (doc_id) join b using (doc_id) cross join figures f)
"""
NOCASE = "translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {f.__name__: f for f in (search_bm25, search_filter_facets, search_page, search_total, search_phrase, search_no_word, search_postings, postings_stats, prefix_dictionary, search_published, lateral_terms, substring_search, get_by_id, alias_resolve, export_ordered, csv_formula_guard, index_text)}
ORACLES = {
    "search_bm25": f"{TWO} select doc_id, title, score from hits where lang = 'en' order by score, {NOCASE}, doc_id limit 10",
    "search_postings": f"{TWO} select doc_id, score from hits",
    "search_published": f"{TWO} select doc_id, score from hits",
    "prefix_dictionary": f"""{TOKENS}, own as (select distinct doc_id, term[1:k.k] as prefix from flat, range(1, {S.PREFIX_CHARS + 1}) k(k) where k.k <= length(term))
        select prefix, count(*) as docs from own group by prefix""",
    "lateral_terms": f"{TOKENS} select term, count(distinct doc_id) as docs, count(*) as occurrences, max(place) as furthest from flat group by term",
    "search_total": f"{TWO} select lang, count(*) as total from hits group by lang",
    "search_filter_facets": f"""{TOKENS}, a as (select doc_id, count(*) as tf from flat where starts_with(term, 'the') group by 1)
        select i.doc_id, i.source, round(-{_score("a.tf", "(select count(*) from a)")}, 6) as score
        from items i join a using (doc_id) join labels l using (doc_id) cross join figures f where i.source = 'src3' and (l.quality = 1 or l.toxic = 1)""",
    "search_phrase": f"""{TOKENS}, a as (select x.doc_id, count(*) as tf from flat x join flat y on x.doc_id = y.doc_id and y.place = x.place + 1 where x.term = 'of' and starts_with(y.term, 'th') group by 1)
        select i.doc_id, round(-{_score("a.tf", "(select count(*) from a)")}, 6) as score from items i join a using (doc_id) cross join figures f""",
    "search_no_word": f"{TOKENS} select * from (values ('... !!', 0), ('the _', 0)) t(query, total) union all select 'the', count(distinct doc_id) from flat where starts_with(term, 'the')",
    "search_page": f"select doc_id, title from (select doc_id, text[1:60] as title from documents) order by {NOCASE}, doc_id limit 24 offset 48",
    "postings_stats": f"{TOKENS} select term, count(distinct doc_id) as docs, count(*) as occurrences from flat group by term having count(distinct doc_id) >= 3",
    "substring_search": "select doc_id, length(text || ' ' || source || ' ' || lang) as chars from documents where contains(lower(text || ' ' || source || ' ' || lang), 'thing a')",
    "get_by_id": "select doc_id, lang, source, sha256(text) as digest from documents where doc_id = 42",
    "alias_resolve": """select c.conv_id || ':' || c.turn as id, p.conv_id || ':' || p.turn as canonical_id, p.role as parent_role, length(c.text) as chars
        from conversations c join conversations p on c.conv_id = p.conv_id and p.turn = 0 where c.turn > 0""",
    "export_ordered": """select doc_id, source, '{"lang":"' || lang || '","source":"' || source || '"}' as cell from documents where lang = 'de'""",
    "csv_formula_guard": r"""with c as (select doc_id, ['=', ' +', '-', chr(9) || '@', ''][doc_id % 5 + 1] || text as cell from documents)
        select doc_id, case when regexp_matches(cell, '^[\x09-\x0D\x1C-\x1F\x{85}\p{Z}]*[=+@-]') then '''' else '' end || cell as cell from c""",
    "index_text": f"select conv_id, sha256(string_agg(text, ' ' order by turn, text)[1:{vocab.INDEX_CHARS}]) as digest from conversations group by conv_id",
}
