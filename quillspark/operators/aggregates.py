"""Summaries over answers, records and units. Each is one aggregation over raw rows; no partial summary is stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import stats


def accuracy_by_grain(answers: DataFrame, grains: list[str], correct: str = "correct", by: list[str] | None = None) -> DataFrame:
    """Accuracy blocks overall and by each grain in one pass: ``grain, key, n, correct, accuracy, wilson_lo, wilson_hi``.

    ``by`` repeats all of it, as for each condition. Grouping sets aggregate the same rows once for all grains.
    """
    by = by or []
    sets = [by, *[[*by, g] for g in grains]]
    view = answers.select(*by, *grains, F.col(correct).alias("_correct"))
    grouped = view.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*by, *grains]])
    ids = {g: F.grouping(g) for g in grains}
    rows = grouped.agg(*stats.accuracy_block(F.col("_correct")), *[i.alias(f"_g_{g}") for g, i in ids.items()])
    which = reduce(lambda acc, g: F.when(F.col(f"_g_{g}") == 0, F.lit(g)).otherwise(acc), reversed(grains), F.lit("overall"))
    key = reduce(lambda acc, g: F.when(F.col(f"_g_{g}") == 0, F.col(g).cast("string")).otherwise(acc), reversed(grains), F.lit(None).cast("string"))
    return stats.with_accuracy(rows.select(*by, which.alias("grain"), key.alias("key"), "n", "correct"))


def by_condition(answers: DataFrame, conditions: list[str], condition: str = "condition", correct: str = "correct") -> DataFrame:
    """An accuracy block for each condition of a fixed list, with n = 0 for one without answers."""
    listed = answers.sparkSession.createDataFrame([(c,) for c in conditions], f"{condition} string")
    blocks = answers.groupBy(condition).agg(*stats.accuracy_block(F.col(correct)))
    full = F.broadcast(listed).join(blocks, condition, "left").fillna(0, ["n", "correct"])
    return stats.with_accuracy(full)


def condition_ratio(blocks: DataFrame, num: str, den: str, condition: str = "condition") -> DataFrame:
    """Ratio of two conditions' accuracies with both n beside it, as they needn't be over the same answers."""
    pick = lambda c, what: F.max(F.when(F.col(condition) == c, F.col(what)))
    row = blocks.agg(pick(num, "n").alias("n_num"), pick(den, "n").alias("n_den"), pick(num, "correct").alias("_a"), pick(den, "correct").alias("_b"))
    value = F.try_divide(F.col("_a") * F.col("n_den"), F.col("_b") * F.col("n_num"))
    return row.select(F.lit(f"{num} / {den}").alias("ratio_of"), F.round(value, 6).alias("ratio"), "n_num", "n_den")


def mcnemar(pairs: DataFrame, by: list[str] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Cells, exact p and the ratio of both accuracies on the same pairs."""
    cells = stats.mcnemar_cells(F.col(x), F.col(y))
    rows = pairs.groupBy(*by).agg(*cells) if by else pairs.agg(*cells)
    ratio = stats.ratio(F.col("both") + F.col("only_y"), F.col("both") + F.col("only_x"))
    return rows.withColumn("p", stats.mcnemar_p(F.col("only_x"), F.col("only_y"), F.col("n_pairs"))).withColumn("ratio", ratio)


def taxonomy(rows: DataFrame, by: list[str], verdict: str, kinds: list[str]) -> DataFrame:
    """Counts and shares of each verdict kind, with what has none as ``unjudged``."""
    kinds = [*kinds, "unparsed", "unjudged"]
    seen = F.coalesce(F.col(verdict), F.lit("unjudged"))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(seen == k).alias(f"n_{k}") for k in kinds])
    judged = F.col("n") - F.col("n_unjudged")
    return counts.withColumn("parse_rate", stats.ratio(judged - F.col("n_unparsed"), judged))


def token_savings(paired: DataFrame, plain: str, compressed: str, by: list[str] | None = None) -> DataFrame:
    """Savings by sums, means, medians and the mean of each pair's own, with the number of pairs."""
    aggs = [F.count("*").alias("n_pairs"), *stats.savings_aggregates(F.col(plain), F.col(compressed))]
    return paired.groupBy(*by).agg(*aggs) if by else paired.agg(*aggs)


def visible(completion: Column, reasoning: Column) -> Column:
    """Completion tokens less those of hidden reasoning, which older rows don't tell."""
    return completion - F.coalesce(reasoning, F.lit(0))


def paired_deltas(pairs: DataFrame, plain: str, compressed: str, by: list[str]) -> DataFrame:
    """Median of compressed - plain, and on how many pairs either is smaller."""
    d = F.col(compressed) - F.col(plain)
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.median(d).alias("median_delta"), F.count_if(d < 0).alias("wins"), F.count_if(d > 0).alias("losses"))


def arm_summary(units: DataFrame, arm: str = "arm", state: str = "state", pre: str = "recall_pre", post: str = "recall_post") -> DataFrame:
    """Mean recall before and after repair over checked units only; the other states are counted."""
    checked = F.col(state) == "checked"
    mean = lambda c: F.round(F.avg(F.when(checked, F.col(c))), 4)
    return units.groupBy(arm).agg(
        F.count_if(checked).alias("checked"), F.count_if(~F.coalesce(checked, F.lit(False))).alias("other"), mean(pre).alias("mean_recall_pre"), mean(post).alias("mean_recall_post")
    )


def frontier(levels: DataFrame, keys: list[str], level: str, score: str, savings: str, baseline: str, slack: float = 1) -> DataFrame:
    """Mean score and savings of each level, whether it is on par with the baseline, and the best level on par.

    The best saves most; ties go to the lower level. ``all_failed_first``: no unit's lowest level is on par.
    """
    means = levels.groupBy(*keys, level).agg(F.count("*").alias("n"), F.avg(score).alias("_s"), F.avg(savings).alias("_v"), F.avg(baseline).alias("_b"))
    means = means.withColumn("parity", F.col("_s") >= F.col("_b") - slack)
    best = means.groupBy(*keys).agg(
        F.max_by(F.when(F.col("parity"), F.col(level)), F.when(F.col("parity"), F.struct("_v", -F.col(level)))).alias("best_level"),
        F.round(F.max(F.when(F.col("parity"), F.col("_v"))), 2).alias("best_savings"), F.count_if("parity").alias("n_parity"),
        F.coalesce(F.bool_and(F.when(F.col(level) == 1, ~F.col("parity"))), F.lit(True)).alias("all_failed_first"),
    )
    return best


def usage_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the nested usage struct."""
    return calls.groupBy(*by).agg(*[F.sum(f"usage.{c}").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])


def capped_sample(hits: DataFrame, key: Column, k: int, seed: str) -> DataFrame:
    """At most k hits overall, whatever the slices."""
    from quillspark.operators.ordering import hash_sample

    return hash_sample(hits, key, k, seed)
