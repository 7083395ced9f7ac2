"""One thin query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, digest, importance, jaccard, packing, pii, sessions, sharding, simhash, store, toolcalls, toxicity, vafile
from tesserae.llm import common
from tesserae.llm.common import folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.small_batches(spark)
    return common.table(spark, sf_dir, name)


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: What the turns of a conversation are asked as: a question by the number of its words.
TOOLS = {
    "answer": {"properties": {"query": {"type": "string", "required": True, "maxLength": 400}, "words": {"type": "integer", "required": True, "minimum": 3}}, "additionalProperties": False},
    "summarise": {"properties": {"query": {"type": "string", "required": True}, "words": {"type": "integer", "required": True, "maximum": 120}}, "additionalProperties": False},
}


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn is a call (conversation:turn) that waits for the user's turn before; the assistant's next turn is its result."""
    turns = table(spark, sf_dir, "conversations")
    named = lambda back: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("?")), F.coalesce((F.col("turn") - back).cast("string"), F.lit("?")))
    words = F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.col("text"), " ")))
    asked = turns.where("role = 'user'").select(
        named(0).alias("call_id"),
        named(2).alias("before"),
        F.when(F.col("turn") < 2, F.lit("answer")).otherwise(F.lit("summarise")).alias("name"),
        F.to_json(F.struct(words.alias("words"), F.col("text").alias("query"))).alias("arguments"),
    )
    known = asked.select(F.col("call_id").alias("before"), F.col("call_id").alias("parent_id")).distinct()
    calls = asked.join(known, "before", "left").select("call_id", "parent_id", "name", "arguments")
    results = turns.where("role = 'assistant'").select(named(1).alias("call_id"), F.col("text").alias("content"))
    return toolcalls.link(calls, results, TOOLS).select("*", F.sha2("message", 256).alias("message_sha256")).drop("message")


OP1_SQL = """
with recursive turns as (select coalesce(conv_id::varchar, '?') || ':' as c, * from conversations),
asked as (
  select c || coalesce(turn::varchar, '?') as call_id, c || coalesce((turn - 2)::varchar, '?') as before,
         case when turn < 2 then 'answer' else 'summarise' end as name,
         case when trim(text) = '' then 0 else len(string_split(text, ' ')) end as words, text as query
  from turns where role = 'user'),
calls as (
  select call_id, name, count(*) as n_calls, min(words) as words, min(query) as query,
         max(case when before in (select call_id from asked) then before end) as parent_id
  from asked group by call_id, name),
chain as (
  select call_id, 0::bigint as level from calls where parent_id is null
  union all select calls.call_id, level + 1 from calls join chain on calls.parent_id = chain.call_id),
results as (
  select c || coalesce((turn - 1)::varchar, '?') as call_id, min(text) as content, count(*) as n_results
  from turns where role = 'assistant' group by 1),
linked as (
  select coalesce(calls.call_id, results.call_id) as call_id, name, level, coalesce(n_calls, 0) as n_calls, coalesce(n_results, 0) as n_results, query, words, content,
         coalesce(case when name = 'answer' then concat_ws('; ', case when length(query) > 400 then 'query: over 400 characters' end, case when words < 3 then 'words: under 3' end)
              when name = 'summarise' then case when words > 120 then 'words: over 120' end end, '') as errors
  from calls join chain using (call_id) full join results on calls.call_id = results.call_id)
select call_id, name, level, '' as waits, n_calls, n_results, errors,
       case when n_calls = 0 then 'result without call' when errors <> '' then 'invalid' when n_results = 0 then 'call without result' else 'linked' end as status,
       sha256('{"arguments":' || case when n_calls = 0 then 'null' else '{"query":' || to_json(query)::varchar || ',"words":' || words || '}' end
              || ',"id":' || to_json(call_id)::varchar || ',"name":' || coalesce(to_json(name)::varchar, 'null') || ',"result":' || coalesce(to_json(content)::varchar, 'null') || '}') as message_sha256
from linked
"""


def op2_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest.compare(docs, digest.fit(docs))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, BYTE_RANKS)


def op5_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings where len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) and len(embedding) > 0),
scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counts(pii.find(table(spark, sf_dir, "documents")))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "store")
    store.write(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return store.catalogue(spark, path)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The table of CRC-32, and the CRC-32 of an expression's UTF-8 bytes by it.
CRC_TABLE = "crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: xor(c >> 1, 3988292384 * (c & 1)))) as t)"


def crc32_sql(text: str) -> str:
    byte = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295::bigint)"


OP11_SQL = f"""
with {CRC_TABLE},
texts as (select doc_id, false as target, text from documents union all select null, true, text from benchmark),
said as (
  select row_number() over () as r, doc_id, target,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from texts),
features as (
  select r, target, unnest(list_concat(w, list_transform(range(greatest(len(w) - 1, 0)), lambda i: w[i + 1] || ' ' || w[i + 2]))) as f from said),
counted as (select r, target, f, count(*) as n from features group by all),
coded as (select f, {crc32_sql("f")} % 10000 as b from (select distinct f from counted), crc),
placed as (select r, target, b, n from counted join coded using (f)),
sums as (select sum(n) filter (not target) as s, sum(n) filter (target) as t from placed),
buckets as (
  select b, floor(1000 * ln((coalesce(sum(n) filter (target), 0) + 1)::double * (coalesce(any_value(sums.s), 0) + 10000)::double
         / ((coalesce(sum(n) filter (not target), 0) + 1)::double * (coalesce(any_value(sums.t), 0) + 10000)::double))) as gain
  from placed, sums group by b),
weighed as (select r, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n))::bigint as weight from placed join buckets using (b) where not target group by r),
scored as (
  select r, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from said left join weighed using (r) where not target),
drawn as (
  select r, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= floor(25 * n / 100) then rank end as rank
from scored left join drawn using (r)
"""


def op12_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op13_session_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events that may come some batches late."""
    crc = lambda x: F.crc32(x.cast("string").cast("binary"))
    turns = table(spark, sf_dir, "conversations").where("turn is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"))
    c, h = crc(F.col("conv_id")), crc(F.concat_ws(":", "conv_id", "turn"))
    events = turns.select("conv_id", "turn", c.alias("c"), h.alias("h")).selectExpr(
        "2 * ((conv_id - pmod(conv_id, 8)) div 8) + c % 2 as user",
        "(c div 2) % 7200 + 300 * turn + h % 600 as at",
        "h as value",
        "(h div 600) as g",
    )
    at, g = F.col("at"), F.col("g")
    batch = (at - F.pmod(at, F.lit(1800))) / 1800 + F.when(g % 5 == 0, g % 4).otherwise(0)
    found = sessions.versions(events.select("user", "at", batch.cast("long").alias("batch"), "value"), 240)
    return found.select(
        *("user", "batch", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "n_events", "n_new", "n_retracted"),
        *(F.col("total").alias("h_sum"), "retracted_batch", F.col("retracted_start").alias("retracted_start_s")),
    )


OP13_SQL = f"""
with {CRC_TABLE},
turns as (select conv_id, turn, {crc32_sql("conv_id::varchar")} as c, {crc32_sql("conv_id || ':' || turn")} as h from conversations, crc where turn is not null and conv_id is not null),
events as (
  select 2 * floor(conv_id / 8)::bigint + c % 2 as user, (c // 2) % 7200 + 300 * turn + h % 600 as s, h, h // 600 as g from turns),
dealt as (select user, s, h, floor(s / 1800)::bigint + case when g % 5 = 0 then g % 4 else 0 end as batch from events),
batches as (select distinct user, batch as b from dealt),
so_far as (select user, b, s, h, batch, s - lag(s) over (partition by user, b order by s) as gap from dealt join batches using (user) where batch <= b),
parted as (select *, count(*) filter (gap is null or gap > 240) over (partition by user, b order by s) as part from so_far),
made as (
  select user, b as batch, min(s) as start_s, max(s) as end_s, count(*) as n_events, count(*) filter (batch = b) as n_new, sum(h)::bigint as h_sum
  from parted group by user, b, part having count(*) filter (batch = b) > 0),
after as (
  select v.user, v.batch, v.start_s, min(struct_pack(b := w.batch, s := w.start_s)) as next
  from made v join made w on v.user = w.user and w.batch > v.batch and v.start_s between w.start_s and w.end_s group by all),
before as (select user, next.b as batch, next.s as start_s, count(*) as n from after group by all)
select made.user, made.batch, made.start_s, end_s, n_events, n_new, coalesce(before.n, 0) as n_retracted, h_sum, next.b as retracted_batch, next.s as retracted_start_s
from made left join after using (user, batch, start_s) left join before using (user, batch, start_s)
"""

QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_improbable_digest": op2_improbable_digest,
    "op3_minimax_shards": op3_minimax_shards,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_va_file_topk": op5_va_file_topk,
    "op6_toxicity": op6_toxicity,
    "op7_simhash_classes": op7_simhash_classes,
    "op8_personal_data": op8_personal_data,
    "op9_token_store": op9_token_store,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_importance_draw": op11_importance_draw,
    "op12_jaccard_components": op12_jaccard_components,
    "op13_session_versions": op13_session_versions,
}
ORACLES = {"op1_tool_calls": OP1_SQL, "op5_va_file_topk": OP5_SQL, "op11_importance_draw": OP11_SQL, "op13_session_versions": OP13_SQL}
