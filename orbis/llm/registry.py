"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbis.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbis.llm.tokens import read_token_file, write_token_file

    path = scratch_path(spark, "tokens")
    write_token_file(table(spark, sf_dir, "documents"), path, end_id=2)
    return read_token_file(spark, path, with_ids=False)


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbis.llm.pii import detect

    return detect(table(spark, sf_dir, "documents"))


def op3_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbis.llm.licenses import scan, summary

    return summary(scan(table(spark, sf_dir, "documents")))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbis.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), columns=["doc_id"]).select("row.doc_id", "source", "block", "in_block", "slot", "phase")


def op5_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbis.llm.chat import rotate

    found = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string"))), ",")
    return found.withColumn("mask", mask)


def op6_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbis.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbis.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), end_id=1, most=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbis.llm.quality import judge

    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return found.select("row.doc_id", *[F.col(f"q.{c}").alias(c) for c in counts], "kept")


def op9_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbis.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbis.llm.graphs import build_index, search

    rows = table(spark, sf_dir, "embeddings")
    return search(build_index(rows), rows.filter("vec_id % 50 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_elias_fano_tokens, op2_pii_boosting, op3_license_diagonals, op4_pfair_mixing, op5_perspective_chat, op6_toxicity_kernel, op7_binary_packing, op8_quality_rules, op9_simhash_vptree, op10_graph_ann)}


#: Whole renderings: no conversation here has more than one part of 256 turns.
CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
p AS (SELECT t.conv_id, perspective, turn, t.role = perspective AS own, text,
    CASE WHEN t.role = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || t.role || '|>' || chr(10) END AS head
    FROM t JOIN s ON s.conv_id = t.conv_id),
q AS (SELECT *, head || text || '<|end|>' || chr(10) AS piece FROM p),
o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY turn) - length(piece) AS place FROM q)
SELECT conv_id, perspective, 0::BIGINT AS part, 0::BIGINT AS part_start, count(*)::INT AS n_turns, count(*) FILTER (own)::INT AS n_own,
    string_agg(piece, '' ORDER BY turn) AS rendered,
    string_agg((place + length(head))::BIGINT::VARCHAR || ':' || (place + length(head) + length(text) + 7)::BIGINT::VARCHAR, ',' ORDER BY turn) FILTER (own) AS mask
FROM o GROUP BY conv_id, perspective
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_perspective_chat": CHAT_SQL}
