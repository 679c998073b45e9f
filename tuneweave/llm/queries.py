"""One query per operator, over its whole table with production parameters.

``QUERIES`` maps a name to (builder, DuckDB SQL or None).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversations, divergence, imatch, langid, mixing, ngram_join, packing, pii, ppm, quality,
               ranked, sentencepieces, warc)
from .common import remainder, table


def op1_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


def op4_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 4) == 2)


def op6_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                            remainder(F.col("doc_id"), 3) == 1)


def op8_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(table(spark, sf_dir, "conversations"))


def op13_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(sentencepieces.encode(table(spark, sf_dir, "documents"), decoded=True))


#: SHA-1 in upper-case base32: each five hex digits are twenty bits, four letters.
OP2_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), d as (
  select page_id, octet_length(encode(html)) as payload_bytes,
    list_aggregate(list_transform(range(0, 8), lambda g:
      list_aggregate(list_transform([15, 10, 5, 0], lambda s:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(hex, (5 * g + 1)::int, 5))::bigint >> s) & 31)::int + 1, 1)), 'string_agg', '')),
      'string_agg', '') as payload_digest
  from p
), f as (
  select *, min(page_id) over (partition by payload_digest) as first_page from d
)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id = first_page then 'response' else 'revisit' end as record_type,
  case when page_id = first_page then null else first_page end as refers_to
from f
"""

#: Every score in full, then the ranks.
OP11_SQL = """
with dw as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
  from documents
), d as (select rid, doc_id, w, len(w)::bigint as n from dw where len(w) > 0
), totals as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from d
), q as (
  select iid, item_id, term, count(*)::bigint as q from (
    select iid, item_id, unnest(w) as term from (
      select row_number() over () as iid, item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
      from benchmark))
  group by all
), tf as (
  select rid, doc_id, n, term, count(*)::bigint as tf from (select rid, doc_id, n, unnest(w) as term from d)
  where term in (select term from q) group by all
), w as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tf, totals group by term, n_docs
), s as (
  select iid, item_id, rid, doc_id,
    sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
  from tf join w using (term) join q using (term), totals
  group by all
), r as (
  select item_id, row_number() over (partition by iid order by score desc, doc_id nulls last, rid) as rank, doc_id, score
  from s where score > 0
)
select item_id, rank::int as rank, doc_id, score from r where rank <= 20
"""

QUERIES = {
    "op1_token_group_join": (op1_token_group_join, None),
    "op2_warc_segments": (op2_warc_segments, OP2_SQL),
    "op3_ppm_scores": (op3_ppm_scores, None),
    "op4_pii_bootstrap": (op4_pii_bootstrap, None),
    "op5_unigram_langid": (op5_unigram_langid, None),
    "op6_binary_packing": (op6_binary_packing, None),
    "op7_quality_qda": (op7_quality_qda, None),
    "op8_cube_mixing": (op8_cube_mixing, None),
    "op9_imatch": (op9_imatch, None),
    "op10_divergence_rules": (op10_divergence_rules, None),
    "op11_nra_search": (op11_nra_search, OP11_SQL),
    "op12_conversation_repair": (op12_conversation_repair, None),
    "op13_merge_rounds": (op13_merge_rounds, None),
}
