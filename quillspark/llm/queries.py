"""The queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, embeddings, fim, imatch, lines, lm, mixing, quality, resample, rules, secrets, simhash, toxicity
from quillspark.llm._shared import read


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where("quality = 1")
    return lm.scores(read(spark, sf_dir, "documents"), good)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(read(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(read(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.clusters(read(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_pairs(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(read(spark, sf_dir, "documents")).drop("findings")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(read(spark, sf_dir, "documents"), digests=True)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(read(spark, sf_dir, "documents"))


def audit_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: the numbers of words, and which texts have no score."""
    rows = op1_lm_scores(spark, sf_dir)
    scored = [F.col(c).isNotNull() & (F.abs(c) < 1e6) for c in ("target_loss", "background_loss", "difference")]
    return rows.select("doc_id", "n_tokens", (scored[0] & scored[1] & scored[2]).alias("scored"))


def audit_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: the decoded bytes are those of the text, and texts with bytes alone have tokens, a byte
    each at least."""
    rows = op3_byte_bpe(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes")), "doc_id")
    return rows.select("doc_id", "decoded_sha256", ((F.col("n_tokens") <= F.col("n_bytes")) & ((F.col("n_tokens") > 0) == (F.col("n_bytes") > 0))).alias("in_bounds"))


_WORDS = r"regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0d ]+', ' ', 'g')"


def audit_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: texts of the same words have one fingerprint and one component, which is no larger than
    their smallest id."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase), r"[\x09-\x0d ]+", " "))
    rows = op4_simhash(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", F.md5(words).alias("words")), "doc_id")
    grouped = rows.groupBy("words").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("fingerprints"), F.count_distinct("component_id").alias("components"), (F.max("component_id") <= F.min("doc_id")).alias("low"))
    return grouped


def audit_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: lengths and edited texts."""
    return op8_imatch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256", ((F.col("near_edited") >= 0) & (F.col("near_edited") <= 1) & (F.col("near_next") >= 0) & (F.col("near_next") <= 1)).alias("in_bounds"))


def audit_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: the numbers of base spans."""
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


AUDITS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"audit_op1": audit_op1, "audit_op3": audit_op3, "audit_op4": audit_op4, "audit_op8": audit_op8, "audit_op10": audit_op10}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_line_dedup": op2_line_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash": op4_simhash,
    "op5_embeddings": op5_embeddings,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_imatch": op8_imatch,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
    "op11_resample": op11_resample,
    "op12_fim": op12_fim,
    "op13_quality_rules": op13_quality_rules,
} | AUDITS

ORACLES: dict[str, str] = {
    "op2_line_dedup": lines.LINES_SQL,
    "op5_embeddings": embeddings.EMBEDDINGS_SQL,
    "op7_mixing": mixing.MIX_SQL,
    "op11_resample": resample.RESAMPLE_SQL,
    "op12_fim": fim.FIM_SQL,
    "op13_quality_rules": rules.RULES_SQL,
    "audit_op1": r"select doc_id, len(w)::bigint as n_tokens, len(w) > 0 as scored from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents)",
    "audit_op3": "select doc_id, sha256(coalesce(text, '')) as decoded_sha256, true as in_bounds from documents",
    "audit_op4": f"select md5(trim({_WORDS})) as words, count(*) as n, 1::bigint as fingerprints, 1::bigint as components, true as low from documents group by trim({_WORDS})",
    "audit_op8": """
with d as (select doc_id, coalesce(text, '') as t, lead(coalesce(text, '')) over w as n1, first_value(coalesce(text, '')) over w as n0 from documents window w as (order by doc_id desc))
select doc_id, length(t)::bigint as n_chars, sha256(left(t, (length(t) - length(t) // 3)::int) || left(coalesce(n1, n0), (length(t) // 3)::int)) as edited_sha256, true as in_bounds from d
""",
    "audit_op10": r"""
select doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::bigint as n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint as n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint as n_hex from documents
""",
}
