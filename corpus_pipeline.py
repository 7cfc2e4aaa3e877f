"""Raw documents to encoded training data, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, lines, mixing, nearcopies, quality
from quillspark.llm._shared import discard_since, read, tables, written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in one document only; ``n_chars`` follows the text, which may become empty."""
    return lines.deduplicated(docs).selectExpr(*["length(text) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns]).to(docs.schema)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that of the smallest id."""
    return nearcopies.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is cut or repeated to its target; a document taken in several epochs has as many rows."""
    return mixing.mixed(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, and digests that show that they decode to the text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_common_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level bpe", encode_bytes),
]

#: The first stage fits a model and the third hashes with XXH64: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Results of stages are written to the shared folder, and deleted once read, as are
    all tables that a stage has made on its way."""
    docs = read(spark, sf_dir, "documents")
    before = tables()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
            discard_since(before, docs)
    return docs
