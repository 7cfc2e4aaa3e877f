"""Experiments as tables: worklists, replays of control loops, billing summaries, headline checks, merges.

Calls to models are input rows; what a loop decided is replayed from them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import stats
from quillspark.operators import aggregates, joins
from quillspark.sources import scans, sinks


def worklist(tasks: DataFrame, arms: DataFrame, skip: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units to run (tasks x arms), and those left out with their reason (``skip``: register, arm, reason)."""
    both = tasks.select("id", "register", "len_class").withColumnRenamed("id", "task_id").crossJoin(F.broadcast(arms))
    out = both.join(F.broadcast(skip), ["register", "arm"], "left")
    units = out.where("reason is null").select("task_id", "arm", "register", "len_class")
    return units, out.where("reason is not null").select("task_id", "arm", "register", "len_class", "reason")


def repairs(checks: DataFrame, most: int) -> DataFrame:
    """Replay of the repair loop over numbered fact checks (``arm, task_id, round`` from 0, ``parse_ok, matched, total``).

    The loop goes on while a check can be parsed, recall is below 1 and fewer than ``most`` repairs were made. Gives
    ``state`` (checked, unparsed), recall before and after, and the number of repairs. ``most`` is small.
    """
    open_ = F.col("parse_ok") & (F.col("matched") < F.col("total"))
    recall, at = stats.recall(F.col("parse_ok"), F.col("matched"), F.col("total")), lambda r: F.col("round") == r
    rounds = range(most + 1)  # a few columns for each round, so that a unit's rounds needn't be sorted
    each = [x for r in rounds for x in (F.bool_or(at(r)).alias(f"there{r}"), F.min(F.when(at(r), open_)).alias(f"open{r}"), F.max(F.when(at(r), recall)).alias(f"recall{r}"))]
    units = checks.where(F.col("round").between(0, most)).groupBy("arm", "task_id").agg(F.bool_or(F.col("parse_ok") & at(0)).alias("checked"), *each)
    played, on = [], F.lit(True)
    for r in rounds:
        played.append(on & F.col(f"there{r}"))
        on = on & F.coalesce(f"open{r}", F.lit(True))
    last = lambda value: F.coalesce(*[F.when(played[r], value(r)) for r in reversed(rounds)])
    return units.select(
        "arm", "task_id", F.when(F.col("checked"), "checked").otherwise("unparsed").alias("state"),
        F.col("recall0").alias("recall_pre"), last(lambda r: F.col(f"recall{r}")).alias("recall_post"), last(F.lit).cast(checks.schema["round"].dataType).alias("repairs"),
    )


def surviving_panels(answers: DataFrame, drops: DataFrame) -> DataFrame:
    """Answers of panels that were never dropped: a panel that drops once is out everywhere."""
    return answers.join(F.broadcast(drops.select("panel").distinct()), "panel", "left_anti")


def panel_summary(answers: DataFrame, drops: DataFrame, plain: str, compressed: str) -> DataFrame:
    """For each surviving panel: accuracies of both conditions, their ratio with both n, and the exact test."""
    kept = surviving_panels(answers, drops)
    side = lambda c, name: kept.where(F.col("condition") == c).select("panel", "task_id", "q_index", "question", F.col("correct").alias(name))
    x, y = side(plain, "x"), side(compressed, "y")
    blocks = x.groupBy("panel").agg(F.count("*").alias("n_den"), F.count_if("x").alias("k_den")).join(y.groupBy("panel").agg(F.count("*").alias("n_num"), F.count_if("y").alias("k_num")), "panel")
    test = aggregates.mcnemar(x.join(y, ["panel", "task_id", "q_index", "question"]), ["panel"]).select("panel", "n_pairs", "only_x", "only_y", "p")
    rows = blocks.join(test, "panel", "left")
    return rows.withColumn("ratio", F.round(F.try_divide(F.col("k_num") * F.col("n_den"), F.col("k_den") * F.col("n_num")), 6))


def variants(rows: DataFrame, baseline: str = "V0") -> DataFrame:
    """Savings per turn over the baseline variant, and the turns that pay for the transformation."""
    base = rows.where(F.col("variant") == baseline).groupBy().agg(F.max("bundle_approx_tokens").alias("_base"))
    out = rows.crossJoin(F.broadcast(base)).withColumn("per_turn_saving_approx_tokens", F.col("_base") - F.col("bundle_approx_tokens"))
    return out.withColumn("break_even_turns", stats.break_even(F.col("per_turn_saving_approx_tokens"), F.coalesce("transform_cost_tokens", F.lit(0)))).drop("_base")


def billing(records: DataFrame, plain: str, compressed: str) -> DataFrame:
    """Per pair of conditions: savings of billed, visible and approximate tokens, by medians and by sums, and latencies."""
    usage = F.col("usage.completion_tokens")
    rows = records.select("task_id", "condition", usage.alias("billed"), aggregates.visible(usage, F.col("usage.reasoning_tokens")).alias("visible"), F.col("approx_tokens").alias("approx"), "latency_ms")
    pick = lambda c, what: F.when(F.col("condition") == c, F.col(what))
    out: list[Column] = []
    for what in ("billed", "visible", "approx"):
        for basis, f in (("median", F.median), ("sum", F.sum)):
            out.append(F.round(stats.savings(f(pick(plain, what)), f(pick(compressed, what))), 1).alias(f"{what}_savings_{basis}"))
    out += [F.median(pick(c, "latency_ms")).alias(name) for c, name in ((plain, "plain_ms"), (compressed, "compressed_ms"))]
    reasoned = F.count_if(F.coalesce(F.col("visible") < F.col("billed"), F.lit(False))).alias("rows_with_reasoning")
    return rows.groupBy().agg(F.count("*").alias("n"), reasoned, *out)


def checked(claims: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """``name, got, claim`` with ``ok``: within the tolerance; a value that is missing fails."""
    return claims.withColumn("ok", F.coalesce(F.abs(F.col("got") - F.col("claim")) <= tolerance, F.lit(False)))


def accepted_tasks(facts: DataFrame, share: float = 0.6, per_class: int = 6) -> DataFrame:
    """Generated tasks whose checks parsed and verified enough facts, of classes that have enough of them.

    ``facts``: ``task_id, len_class, parse_ok, verified`` with a row per fact.
    """
    tasks = facts.groupBy("task_id", "len_class").agg(F.bool_and("parse_ok").alias("ok"), F.avg(F.col("verified").cast("double")).alias("rate"))
    good = tasks.where(F.col("ok") & (F.col("rate") >= share))
    enough = good.groupBy("len_class").agg(F.count("*").alias("n")).where(F.col("n") >= per_class)
    return good.join(enough, "len_class", "left_semi")


def merge(records: DataFrame, path: str) -> DataFrame:
    """Merge slices into one ledger (overwritten, so merging again changes nothing) and read it back."""
    sinks.merge_ledger(records, path)
    return scans.ledger(records.sparkSession, path)


def slots(total: int, n: int) -> list[tuple[int, int]]:
    """Offset and length of each of ``n`` slices of ``total`` rows, as ``functions.stats.tile``."""
    base, rest = divmod(total, n)
    return [(i * base + min(i, rest), base + (i < rest)) for i in range(n)]


def quota_rounds(deficit: int, per_call: int, most: int = 2) -> int:
    """Generation rounds that a deficit takes, or an error if they are more than allowed."""
    rounds = math.ceil(max(0, deficit) / per_call)
    if rounds > most:
        raise ValueError(f"{deficit} items are missing after {most} rounds of {per_call}")
    return rounds


def judge_worklist(answers: DataFrame, sample: int = 100, seed: str = "judge") -> DataFrame:
    """All misses and a global sample of hits, whatever the slices they come from."""
    key = F.concat_ws("|", "task_id", F.col("q_index").cast("string"), "question")
    hits = aggregates.capped_sample(answers.where("correct"), key, sample, seed).withColumn("sampled_hit", F.lit(True))
    return answers.where("not correct").withColumn("sampled_hit", F.lit(False)).unionByName(hits)


def sessions_are_apart(train: DataFrame, test: DataFrame, session: str) -> bool:
    return joins.disjoint(train, test, [session])
