"""Statistics of paired conditions, as Column arithmetic: undefined values are null, never 0 or NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % point of the normal distribution, to six places.
Z = 1.959964


def ratio(num: Column, den: Column, places: int = 6) -> Column:
    """Null if either is null or the denominator is 0."""
    return F.round(F.try_divide(num, den), places)


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within 0 and 1, 6 places; null without trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = (z / den) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.round(F.when(n.isNotNull(), F.greatest(F.lit(0.0), mid - half)), 6), F.round(F.when(n.isNotNull(), F.least(F.lit(1.0), mid + half)), 6)


def _log_factorial(n: Column) -> Column:
    """Exact up to 20, then by Stirling's series, which is off by less than 1e-12."""
    x = n.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")))).otherwise(series)


def mcnemar_p(b: Column, c: Column, pairs: Column) -> Column:
    """Exact two-sided p of ``b`` and ``c`` discordant pairs, 6 places; 1 if none is discordant, null without pairs.

    The binomial tail is summed from its largest term down to where terms vanish, 16 standard deviations away, by
    logarithms: the steps grow with the root of the number of pairs, and nothing overflows.
    """
    n, m = (b + c).cast("bigint"), F.least(b, c).cast("bigint")
    top = _log_factorial(n) - _log_factorial(m) - _log_factorial(n - m) - n * math.log(2.0)
    steps = F.least(m, F.ceil(8 * F.sqrt(n.cast("double"))) + 40).cast("int")
    start = F.struct(top.alias("log"), F.exp(top).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.ln((m - i + 1) / (n - m + i))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    each = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(each, start, add, lambda acc: F.least(F.lit(1.0), 2 * acc["sum"]))
    return F.when(pairs > 0, F.when(b + c == 0, F.lit(1.0)).otherwise(F.round(tail, 6)))


def mcnemar_cells(x: Column, y: Column) -> list[Column]:
    """Aggregates of two verdicts per pair: n, both right, only x, only y, neither."""
    return [
        F.count("*").alias("n_pairs"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_x"),
        F.count_if(~x & y).alias("only_y"), F.count_if(~x & ~y).alias("neither"),
    ]


def accuracy_block(correct: Column) -> list[Column]:
    """Aggregates n and correct; finish with ``with_accuracy``."""
    return [F.count("*").alias("n"), F.coalesce(F.count_if(correct), F.lit(0)).alias("correct")]


def with_accuracy(df: DataFrame) -> DataFrame:
    """Accuracy (6 places) and Wilson bounds beside n and correct; null where n is 0."""
    low, high = wilson(F.col("correct"), F.col("n"))
    return df.withColumns({"accuracy": ratio(F.col("correct"), F.col("n")), "wilson_lo": low, "wilson_hi": high})


def savings(plain: Column, compressed: Column) -> Column:
    """100 * (1 - compressed / plain), of sums, means or medians; null if either is null or 0."""
    return 100 * (1 - F.try_divide(F.nullif(compressed.cast("double"), F.lit(0.0)), plain.cast("double")))


def savings_aggregates(plain: Column, compressed: Column) -> list[Column]:
    """All three bases, named for what they are. They differ: say which one is meant."""
    return [
        F.round(savings(F.sum(plain), F.sum(compressed)), 2).alias("savings_sum"), F.round(savings(F.avg(plain), F.avg(compressed)), 2).alias("savings_mean"),
        F.round(savings(F.median(plain), F.median(compressed)), 1).alias("savings_median"), F.round(F.avg(savings(plain, compressed)), 2).alias("savings_unit_mean"),
    ]


def order_statistic(value: str, p: float, keys: list[str], df: DataFrame) -> DataFrame:
    """The value at rank floor(p * (n - 1)) of each group, without interpolation. Sorted in a window, never gathered."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumn("_rank", F.row_number().over(by.orderBy(value)) - 1).withColumn("_n", F.count("*").over(by))
    return ranked.where(F.col("_rank") == F.floor(p * (F.col("_n") - 1))).select(*keys, value)


def hash_number(key: Column) -> Column:
    """60 bits of the MD5 of a string: the same number in any engine."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def cluster_bootstrap(answers: DataFrame, task: str, correct: str, draws: int = 2000, seed: str = "boot") -> DataFrame:
    """95 % interval of the accuracy when tasks, not answers, are drawn with replacement: one row ``n_tasks``, ``lo``, ``hi``.

    Answers collapse to a row per task first, so what is drawn from doesn't grow with the answers. Draw i of resample
    r takes the task numbered by a hash of (seed, r, i). No answers give null bounds.
    """
    per_task = answers.groupBy(task).agg(F.count_if(F.col(correct)).alias("k"), F.count("*").alias("n"))
    numbered = per_task.withColumn("pos", F.row_number().over(Window.orderBy(task)) - 1)
    m = numbered.agg(F.count("*").alias("m"))
    spark = answers.sparkSession
    picks = spark.range(draws).withColumnRenamed("id", "resample").crossJoin(F.broadcast(m))
    picks = picks.withColumn("i", F.explode(F.when(F.col("m") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))))
    key = F.concat_ws(":", F.lit(seed), F.col("resample").cast("string"), F.col("i").cast("string"))
    picks = picks.select("resample", "m", F.pmod(hash_number(key), F.col("m")).alias("pos"))
    sums = picks.join(numbered, "pos").groupBy("resample").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.max("m").alias("n_tasks"))
    ranked = sums.select("n_tasks", (F.col("k") / F.col("n")).alias("acc")).withColumn("rank", F.row_number().over(Window.orderBy("acc")) - 1)
    low, high = int(0.025 * (draws - 1)), int(0.975 * (draws - 1))
    at = lambda r: F.round(F.max(F.when(F.col("rank") == r, F.col("acc"))), 6)
    return ranked.agg(F.max("n_tasks").alias("n_tasks"), at(low).alias("lo"), at(high).alias("hi"))


def break_even(saving: Column, cost: Column) -> Column:
    """Turns until a one-off cost is paid back: 1 if it costs nothing, null if nothing is saved."""
    return F.when(saving > 0, F.when(cost > 0, F.ceil(cost / saving)).otherwise(F.lit(1))).cast("bigint")


def recall(parse_ok: Column, matched: Column, total: Column) -> Column:
    """Matched share of all facts; null if the check couldn't be parsed or there are none."""
    return F.when(parse_ok, F.try_divide(matched, F.nullif(total, F.lit(0))))


def tile(slot: Column, slots: int, total: Column) -> tuple[Column, Column]:
    """Offset and length of one of ``slots`` slices that together cover 0..total exactly."""
    base, rest = F.floor(total / slots), total % slots
    return (slot * base + F.least(slot, rest)).cast("bigint"), (base + (slot < rest).cast("int")).cast("bigint")


def place_in(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` lie below a value (null for null), by two searches of about their square root."""
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))
    step = math.isqrt(len(cuts)) + 1
    rows = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    below = lambda some: F.size(F.filter(some, lambda c: c < value))
    coarse = below(F.array(*[F.lit(r[-1]) for r in rows]))
    row = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in rows]), F.least(coarse + 1, F.lit(len(rows))))
    fine = F.when(coarse < len(rows), below(row)).otherwise(0)
    return F.when(value.isNotNull(), F.least(coarse * step + fine, F.lit(len(cuts))))
