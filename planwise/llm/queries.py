"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, media, mixing, pii, simhash, topk, toxicity, warc
from .shared import table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    from .shared import materialize

    store = media.media_store(docs).select("digest", media.read_back(F.col("media")).alias("_r")).select("digest", "_r.*")
    pages = docs.select("doc_id", media.page_of(F.col("text")).alias("_p")).select("doc_id", "_p.n_bytes", "_p.html")
    sequence = media.interleave(pages, ["doc_id", "n_bytes"], "html").where("kind = 'media'")
    found = media.resolve(sequence, materialize(store, "media-store"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = pages.select("page_id", warc.responses("2024-01-01T00:00:00Z")(F.col("url"), F.col("html")).alias("record"))
    derived = warc.derive_records(records, ["page_id"])
    return derived.select("page_id", "record_type", "record_id", "refers_to", warc.record_fields(F.col("record")).alias("_f")).select("page_id", "record_type", "record_id", "refers_to", "_f.*")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat.digests(chat.windows(given.unionByName(added)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def toxicity_grammar(docs: DataFrame, labels: DataFrame) -> toxicity.Grammar:
    return toxicity.learn(docs, labels, fold("id", 5) != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity_grammar(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), toxicity.toxicity(docs, grammar).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_offset")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages, matrix = langid.learn(docs.where(fold("doc_id", 3) != 1))
    return docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), langid.identify(docs, languages, matrix).alias("_p")).select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.anonymize(docs).select("doc_id", "text", F.size("_entities").alias("n_entities"), F.col("_entities").alias("entities"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_media, op3_warc, op4_chat, op5_simhash, op6_toxicity, op7_mixing, op8_langid, op9_pii, op10_topk)}

ORACLE_SQL = {
    "op4_chat": """
with b as (
  select conv_id, turn, role, text, '<|im_start|>' || replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2') || chr(10) || replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2') || '<|im_end|>' || chr(10) as body
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
), p as (
  select *, coalesce(sum(ceil(length(body) / 4.0)::bigint) over (w rows between unbounded preceding and 1 preceding), 0) as begins, row_number() over w - 1 as place from b window w as (partition by conv_id order by turn, role, text)
), s as (select *, begins // 1024 as span, place = 0 and role = 'system' as is_system from p),
n as (select conv_id, span, lead(span) over w as nxt, lead(start) over w as nxt_start, count(*) over (partition by conv_id) as spans from (select conv_id, span, min(begins) as start from s group by conv_id, span) window w as (partition by conv_id order by span))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(body) * (1 + case when is_system then spans - 1 when nxt is not null and nxt_start - begins <= 256 then 1 else 0 end))::bigint as formatted_chars, any_value(spans) as n_windows
from s join n using (conv_id, span) group by conv_id
""",
    "op7_mixing": """
with recursive w as (select source, floor(sqrt(count(*)::double) * 1000)::bigint as w from documents where source is not null group by source),
f as (select source, w * (1000 - n) // total as whole, w * (1000 - n) % total as rest, n from w cross join (select sum(w)::bigint as total, count(*) as n from w)),
a as (select source, (1 + whole + (row_number() over (order by rest desc, source) <= 1000 - n - sum(whole) over ())::int)::bigint as a from f),
l as (select list(a order by source) as aa, list(source order by source) as names, count(*) as n from a),
sim as (
  select -1 as slot, list_transform(range(1, n + 1), lambda i: 1::bigint) as ks, 0::bigint as chosen from l
  union all
  select slot + 1, list_transform(range(1, n + 1), lambda i: ks[i] + (i = best % 10000)::int::bigint), best % 10000 from (
    select slot, ks, n, list_min(list_transform(range(1, n + 1), lambda i: case when (ks[i] - 1) * 1000 // aa[i] <= slot + 1 then (ks[i] * 1000 + aa[i] - 1) // aa[i] * 100000000 + (ks[i] - 1) * 1000 // aa[i] * 10000 + i end)) as best from sim cross join l where slot < 999)),
t as (select slot, names[chosen] as source, row_number() over (partition by chosen order by slot) as k from sim cross join l where slot >= 0),
d as (select doc_id, source, row_number() over (partition by source order by md5(coalesce(doc_id::varchar, '')), doc_id) - 1 as r from documents)
select d.doc_id, d.source, r // 64 + 1 as mix_block, (r // 64 // a * 1000 + t.slot)::bigint as mix_slot, (r % 64)::int as mix_offset
from d join a on a.source = d.source join t on t.source = d.source and t.k = r // 64 % a + 1
""",
    "op10_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as vec from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.vec, c.vec)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.vec) = len(c.vec) where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
""",
}
