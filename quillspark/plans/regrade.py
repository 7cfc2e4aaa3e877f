"""Offline regrading of a run: scan, de-duplicate, look passages up, grade, summarise. Nothing calls a model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import stats
from quillspark.functions.text import ANCHOR_THRESHOLD, MATCH_THRESHOLD, grade
from quillspark.operators import aggregates, joins
from quillspark.operators.ordering import last_attempt
from quillspark.sources import scans

#: The answer conditions and record kinds of a paired experiment.
CONDITIONS = ("A-PLAIN-DIRECT", "A-FROM-PLAIN", "A-FROM-COMPRESSED", "A-COMPRESSED-DIRECT", "DECODE")
PLAIN, COMPRESSED = "R-PLAIN", "R-CABLESE"
KEY = ["task_id", "q_index", "question"]


@dataclass
class Regrade:
    rows: DataFrame  # each answer with its new and old verdict
    blocks: DataFrame  # accuracy by condition
    ratios: DataFrame  # with the n of both sides
    mcnemar: DataFrame
    tokens: DataFrame  # savings by sums, means, medians


def graded(answers: DataFrame, passages: DataFrame, anchor: float = ANCHOR_THRESHOLD, match: float = MATCH_THRESHOLD) -> DataFrame:
    """Answers with ``regrade`` (struct) and ``was``; an answer without a passage is an error."""
    rows = scans.resolved(answers, passages.select("task_id", "passage"))
    rows = rows.withColumn("regrade", grade("expected", "raw_answer", "passage", anchor, match)).withColumnRenamed("correct", "was")
    return rows.withColumn("correct", F.col("regrade.correct")).drop("passage")


def paired_records(records: DataFrame) -> DataFrame:
    """``task_id, plain, compressed`` tokens of the last attempt at each record."""
    tokens = scans.source_tokens(records)
    wide = joins.pivoted(tokens, "task_id", "condition", "approx_tokens", [PLAIN, COMPRESSED])
    return wide.withColumnRenamed(PLAIN, "plain").withColumnRenamed(COMPRESSED, "compressed").where("plain is not null and compressed is not null")


def conditions_run(records: DataFrame, passages: DataFrame, conditions: tuple[str, ...] = CONDITIONS) -> Regrade:
    """Regrade answers under several conditions. Accuracies are over all rows; pairs are over the last attempt at each
    question, with the question in the key, since task and index alone don't tell questions apart."""
    answers = scans.view(records.withColumn("attempt", F.coalesce("attempt", F.lit(0))), "cond_answer")
    rows = graded(answers, passages)
    blocks = aggregates.by_condition(rows, list(conditions))
    ratios = aggregates.condition_ratio(blocks, "A-FROM-COMPRESSED", "A-FROM-PLAIN").unionByName(aggregates.condition_ratio(blocks, "DECODE", "A-PLAIN-DIRECT"))
    latest = last_attempt(rows.select(*KEY, "condition", "correct", "run_id", "raw_answer"), [*KEY, "condition"], ["run_id", "raw_answer"])
    side = lambda c: latest.where(F.col("condition") == c)
    pairs = joins.paired(side("A-FROM-PLAIN"), side("A-FROM-COMPRESSED"), KEY)
    return Regrade(rows, blocks, ratios, aggregates.mcnemar(pairs), aggregates.token_savings(paired_records(records), "plain", "compressed"))


def quiz_run(records: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regrade a baseline run: rows, and accuracy overall, by type, register and task."""
    rows = graded(scans.view(records, "quiz_answer"), passages)
    return rows, aggregates.accuracy_by_grain(rows, ["q_type", "register", "task_id"])


def baseline_summary(records: DataFrame) -> DataFrame:
    """One row: verdict counts of judged misses and sampled hits, false-negative and false-positive rates, parse rate,
    dropped and rejected items. Judgements inform, they never change a verdict."""
    answers = scans.view(records, "quiz_answer").groupBy().agg(*stats.accuracy_block(F.col("correct")))
    judged = scans.view(records, "judge")
    hit = F.coalesce(F.col("sampled_hit"), F.lit(False))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    verdict = F.col("verdict")
    counts = judged.groupBy().agg(
        F.count("*").alias("judged"), n(~hit).alias("judged_misses"), n(hit).alias("judged_hits"), n(~hit & (verdict == "grader_wrong")).alias("false_negatives"),
        n(hit & (verdict == "wrong")).alias("false_positives"), n(verdict == "unparsed").alias("unparsed"),
    )
    kinds = records.groupBy().agg(n(F.col("type") == "dedupe_drop").alias("dropped"), n(F.col("type").isin("anchor_reject", "unanchored_reject")).alias("rejected"))
    row = stats.with_accuracy(answers).crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(kinds))
    return row.withColumns({
        "fn_rate": stats.ratio(F.col("false_negatives"), F.col("judged_misses")), "fp_rate": stats.ratio(F.col("false_positives"), F.col("judged_hits")),
        "parse_rate": stats.ratio(F.col("judged") - F.col("unparsed"), F.col("judged")), "drop_rate": stats.ratio(F.col("dropped"), F.col("dropped") + F.col("n")),
    })


def decode_summary(decoded: DataFrame, source: DataFrame, tokens: DataFrame) -> DataFrame:
    """Decoded answers against the source run's: accuracy, ratio and exact test on common questions, mean tokens by condition.

    The source's accuracy is joined, not written down as a constant; n of both sides stand beside the ratio.
    """
    mine = decoded.groupBy().agg(*stats.accuracy_block(F.col("correct")))
    base = source.groupBy().agg(F.count("*").alias("n_source"), F.count_if("correct").alias("source_correct"))
    test = aggregates.mcnemar(joins.paired(source, decoded, KEY)).select("n_pairs", "only_x", "only_y", "p", F.col("ratio").alias("paired_ratio"))
    means = tokens.groupBy().pivot("condition").agg(F.round(F.avg("approx_tokens"), 2)) if "condition" in tokens.columns else tokens
    row = stats.with_accuracy(mine).crossJoin(F.broadcast(base)).crossJoin(F.broadcast(test)).crossJoin(F.broadcast(means))
    return row.withColumn("ratio", F.round(F.try_divide(F.col("correct") * F.col("n_source"), F.col("source_correct") * F.col("n")), 6))


def readability(answers: DataFrame, source: DataFrame) -> DataFrame:
    """Accuracy by condition over the accuracy of the source run."""
    base = source.groupBy().agg(F.avg(F.col("correct").cast("double")).alias("source_accuracy"))
    blocks = stats.with_accuracy(answers.groupBy("condition").agg(*stats.accuracy_block(F.col("correct"))))
    return blocks.crossJoin(F.broadcast(base)).withColumn("ratio", stats.ratio(F.col("accuracy"), F.col("source_accuracy"), 4))
