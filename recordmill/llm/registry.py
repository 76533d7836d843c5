"""The queries that apply this package's operators to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, language, packing, quality, repetition, simhash, suffix_dedup, topk, toxicity
from .common import table


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo; null keys count as 0 of a fold that nothing is learned from nor held out."""
    return F.crc32(F.col(key).cast("string")) % modulus


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op2_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    prototypes = language.fit(documents, fold(4) != 2)
    held = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    found = language.predict(documents.select("doc_id", "text", held), prototypes)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), fold(5) != 0)
    held = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    found = toxicity.score(documents.select("doc_id", "text", held), model)
    return found.select("doc_id", "held_out", "score", "predicted")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def site_path() -> Column:
    """The path level of a document's site: its source, then its language."""
    return F.concat_ws("/", F.col("source"), F.col("lang"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), site_path(), keep=["doc_id", "source"])
    return found.select("doc_id", "source", "doc_logit", "host_posterior", "path_posterior", "quality_score", F.col("quality_kept").alias("kept"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_chat_perspectives, op2_suffix_array_repetition, op3_suffix_array_dedup, op4_language_id, op5_toxicity, op6_bpe_round_trip,
        op7_simhash_near_dedup, op8_best_two_fit_packing, op9_exact_top_k, op10_quality_classifier,
    ]
    return {f.__name__: f for f in named}


#: Turns in order, rendered for every speaker but the system.
OP1_SQL = """
with rows as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), text) as pos
  from conversations
), people as (
  select distinct conv_id, speaker as perspective from rows where speaker <> 'system'
), sent as (
  select r.conv_id, perspective, turn, speaker, pos, text,
         case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role,
         case when speaker <> 'system' and speaker <> perspective then speaker end as name
  from rows r join people p on r.conv_id is not distinct from p.conv_id
), rendered as (
  select *, '<|' || role || coalesce(' name=' || name, '') || '|>' || chr(10) || text || '<|end|>' || chr(10) as segment from sent
), placed as (
  select *, cast(sum(length(segment)) over (partition by conv_id, perspective order by pos) as bigint) as "end" from rendered
)
select conv_id, perspective, turn, speaker, role, name, segment, "end" - length(segment) as start, "end",
       case when speaker = perspective then "end" - length(text) - 8 end as mask_start,
       case when speaker = perspective then "end" - 1 end as mask_end
from placed
"""

#: Covered words of 8-word windows found twice are the union of maximal repeats of 8 words or more, and a repeat of more than
#: 60 words is a 61-word window found twice.
OP2_SQL = """
with base as (
  select doc_id, coalesce(text, '') as text, row_number() over () as rid,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents
), words as (
  select rid, w[i] as word, i from (select rid, w, unnest(range(1, len(w) + 1)) as i from base)
), grams as (
  select rid, i, list(word) over (partition by rid order by i rows between current row and 7 following) as g8,
         list(word) over (partition by rid order by i rows between current row and 60 following) as g61
  from words
), hashed as (
  select rid, i, case when len(g8) = 8 then md5(array_to_string(g8, ' ')) end as h8, case when len(g61) = 61 then md5(array_to_string(g61, ' ')) end as h61 from grams
), counted as (
  select rid, i, case when h8 is not null then count(*) over (partition by rid, h8) > 1 else false end as twice8,
         case when h61 is not null then count(*) over (partition by rid, h61) > 1 else false end as twice61
  from hashed
), marked as (
  select rid, i, twice61, bool_or(twice8) over (partition by rid order by i rows between 7 preceding and current row) as under from counted
), sums as (
  select rid, count_if(under) as n_repeat_words, bool_or(twice61) as too_long from marked group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
       cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
       cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
       cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
       len(w) < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * len(w) as base_failed,
       not (len(w) < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * len(w)) and not coalesce(too_long, false) as kept
from base left join sums using (rid)
"""

#: Every 100-byte window by its hash; the windows that come again cover spans, and what lies between the spans is kept.
OP3_SQL = """
with d as (
  select row_number() over (order by doc_id nulls last, text) as rid, doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents
), starts as (
  select rid, unnest(range(0, n - 99, 128)) as base from d where n >= 100
), chunks as materialized (
  select rid, base, least(128, n - 99 - base) as m, substr(h, cast(2 * base + 1 as bigint), 454) as piece from starts join d using (rid)
), w as (
  select rid, base, piece, unnest(range(0, m)) as o from chunks
), k as (
  select rid, base + o as i, md5_number(substr(piece, cast(2 * o + 1 as bigint), 200)) as key from w
), f as (
  select key, min(rid * 4294967296 + i) as first from k group by key having count(*) > 1
), m as (
  select rid, i, case when i > lag(i) over (partition by rid order by i) + 100 then 1 else 0 end as fresh from k join f using (key) where rid * 4294967296 + i <> first
), g as (
  select rid, i, sum(fresh) over (partition by rid order by i) as span from m
), s as (
  select rid, min(i) as a, max(i) + 100 as b from g group by rid, span
), p as (
  select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as before, max(b) over (partition by rid) as last from s
), kept as (
  select rid, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, cast(2 * before + 1 as bigint), cast(2 * (a - before) as bigint)), '' order by a) || any_value(substr(h, cast(2 * last + 1 as bigint))) as left_over
  from p join d using (rid) group by rid
)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(left_over, h))) as kept_sha256
from d left join kept using (rid)
"""

OP9_SQL = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from rows q join rows c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_perspectives": OP1_SQL, "op2_suffix_array_repetition": OP2_SQL, "op3_suffix_array_dedup": OP3_SQL, "op9_exact_top_k": OP9_SQL}
