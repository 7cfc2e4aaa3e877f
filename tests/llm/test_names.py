"""Extra columns with odd and clashing names pass through, or are left alone."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, fim, imatch, lines, lm, mixing, nearcopies, quality, resample, rules, secrets, simhash, toxicity

NAMES = ("a.b", "id", "fp", "rep", "key", "h", "h1", "size", "sig", "y", "x", "node", "_q_gone", "log_odds", "host", "pid", "taken", "n_tokens", "source_size", "back`tick", "word", "target")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some words of text {i % 9} and more of them here\nline {i % 3}" * (1 + i % 3), f"s{i % 6}", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    return df.select("*", *[F.lit(f"extra {n}").alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(40)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("stage", [lines.deduplicated, nearcopies.deduplicated, mixing.mixed])
def test_passing_through(docs, stage):
    out = stage(docs)
    assert out.columns == docs.columns and {r["a.b"] for r in out.collect()} == {"extra a.b"}


def test_kept(docs, labels):
    out = quality.kept(docs, labels)
    assert out.columns == docs.columns and out.count() <= 40


def test_left_alone(docs, labels):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    results = [
        bpe.encode(docs, vocabulary, public_tokenizers.PATTERN), simhash.clusters(docs), mixing.mix(docs), imatch.edited_pairs(docs), secrets.find(docs),
        lm.scores(docs, labels.where("quality = 1")), quality.scores(docs, labels), toxicity.scores(docs, labels),
        resample.resample(docs, docs), fim.transform(docs), rules.judged(docs),
    ]
    assert all(r.count() == 40 for r in results)
