"""Exact order statistics without sorting, and a bootstrap of sums.

Selection refines histograms: each pass counts the values of every group by a fixed number of bins, which adds up before
anything is sent, and goes on within the bin that holds the wanted rank. No task ever holds a group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType

from quillspark.sources.scratch import written

#: Bins of a pass. A bin with so few values is listed instead of being split again.
BINS, FEW = 4096, 512
#: Bins of a pass by a sketch.
SKETCHED = 100


def _same(left: str, right: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def select_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], bins: int = BINS, few: int = FEW) -> DataFrame:
    """For each group the values at some places of its order: ``keys, n`` and a column for each of ``ranks``, which give a place
    (from 0) by the number of values ``n``. Nulls don't count; a group without values has n = 0 and nulls; NaN comes last.

    A pass splits the open range of each group and rank evenly, so that its least and greatest value never share a bin; every
    second pass splits it by a sketch of its quantiles, so that far outliers don't cost a pass for each order of
    magnitude. Ranges come from values, so results are exact.
    """
    # an empty list of keys is one group
    kind = df.schema[value].dataType
    floats = isinstance(kind, FractionalType) and not isinstance(kind, DecimalType)
    nan = F.isnan("v") if floats else F.lit(False)
    rows = written(df.select(*keys, F.col(value).alias("v")), "values")
    real = rows.where(F.col("v").isNotNull() & ~nan)
    ends = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.count_if(nan).alias("n_nan"), F.min(F.when(~nan, F.col("v"))).alias("lo"), F.max(F.when(~nan, F.col("v"))).alias("hi"))
    state = ends.select("*", F.explode(F.array(*[F.struct(F.lit(name).alias("what"), at(F.col("n")).cast("bigint").alias("rank")) for name, at in ranks.items()])).alias("w")).select("*", "w.*").drop("w")
    state = written(state.where("n > 0"), "ranks")
    own = [*keys, "what"]
    past = F.col("rank") >= F.col("n") - F.col("n_nan")
    done = [state.where(past).select(*own, F.lit(float("nan") if floats else None).cast(kind).alias("v")), state.where(~past & (F.col("lo") == F.col("hi"))).select(*own, F.col("lo").alias("v"))]
    exact = "decimal(38,0)" if kind.typeName() in ("byte", "short", "integer", "long") else None
    far = lambda x, lo: (x.cast(exact) - lo.cast(exact)).cast("double") if exact else x.cast("double") / 2 - lo.cast("double") / 2
    open_, turn = state.where(~past & (F.col("lo") < F.col("hi"))).select(*own, "rank", "lo", "hi"), 0
    while not (open_ := written(open_, "open")).isEmpty():
        if by_sketch := turn % 2 == 1:
            own_rows = real.alias("r").join(open_.alias("o"), [*_same("r", "o", keys), F.col("r.v") >= F.col("o.lo"), F.col("r.v") <= F.col("o.hi")])
            sketch = own_rows.groupBy(*[f"o.{k}" for k in own]).agg(F.percentile_approx("r.v", [q / SKETCHED for q in range(1, SKETCHED)], 10 * SKETCHED).alias("cuts"))
            open_ = written(open_.alias("o").join(sketch.alias("s"), _same("o", "s", own)).select("o.*", "s.cuts"), "open")
            place = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        else:
            share = far(F.col("v"), F.col("lo")) / far(F.col("hi"), F.col("lo"))
            place = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), bins - 1).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(share * bins))))
        within = real.alias("r").join(open_.alias("o"), [*_same("r", "o", keys), F.col("r.v") >= F.col("o.lo"), F.col("r.v") <= F.col("o.hi")])
        within = within.select(*[f"o.{k}" for k in own], "o.rank", "o.lo", "o.hi", "r.v", *["o.cuts"] * by_sketch)
        counts = within.groupBy(*own, "rank", place.cast("int").alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row a bin
        counts = counts.withColumn("upto", F.sum("c").over(upto))
        hit = counts.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        hit = written(hit.select(*own, (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), "lo", "hi", "c"), "bins")
        done.append(hit.where(F.col("lo") == F.col("hi")).select(*own, F.col("lo").alias("v")))
        small = hit.where((F.col("lo") < F.col("hi")) & (F.col("c") <= few))
        listed = real.alias("r").join(small.alias("o"), [*_same("r", "o", keys), F.col("r.v") >= F.col("o.lo"), F.col("r.v") <= F.col("o.hi")])
        listed = listed.groupBy(*[f"o.{k}" for k in own], "o.rank").agg(F.array_sort(F.collect_list("r.v")).alias("vs"))  # at most ``few`` a group
        done.append(listed.select(*own, F.get("vs", F.col("rank").cast("int")).alias("v")))
        open_, turn = hit.where((F.col("lo") < F.col("hi")) & (F.col("c") > few)).select(*own, "rank", "lo", "hi"), turn + 1
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("what") == name, F.col("v"))).alias(name) for name in ranks])
    out = ends.select(*keys, "n").alias("e").join(wide.alias("w"), _same("e", "w", keys) or F.lit(True), "left")
    return out.select(*[f"e.{k}" for k in keys], "e.n", *[f"w.{name}" for name in ranks])


def medians(df: DataFrame, keys: list[str], values: dict[str, Column], bins: int = BINS, few: int = FEW) -> DataFrame:
    """``keys`` and the median of each of ``values`` (doubles; the mean of both middle ones, null without values)."""
    each = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("_of"), v.cast("double").alias("_v")) for name, v in values.items()])).alias("x")).select(*keys, "x.*")
    middle = {"_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2)}
    found = select_ranks(each, [*keys, "_of"], "_v", middle, bins, few)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_of") == name, (F.col("_a") + F.col("_b")) / 2)).alias(name) for name in values])


#: Fixed value: a prime below which numbers multiply within 63 bits.
PRIME = 2**31 - 1


def poisson_points(prime: int = PRIME, most: int = 12) -> list[int]:
    """Where the distribution function of a Poisson variable of mean 1 steps to 1, 2, ..., in parts of ``prime``."""
    total, points = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        points.append(min(prime, math.floor(total * prime)))
    return points


def resample_lines(draws: int, seed: str) -> list[tuple[int, int]]:
    """Slope and offset of each resample's hash of a task's number."""
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    return [(number(f"{seed}:a:{r}") % (PRIME - 1) + 1, number(f"{seed}:b:{r}") % PRIME) for r in range(draws)]


def poisson_bootstrap(answers: DataFrame, task: str, correct: str, draws: int = 2000, seed: str = "boot") -> DataFrame:
    """95 % interval of the accuracy when tasks, not answers, are drawn again: one row ``n_tasks``, ``lo``, ``hi``.

    A resample takes each task as often as a Poisson variable of mean 1 says, by a hash of the task and the resample that
    makes tasks independent in pairs. So nothing is numbered, joined or drawn from: each part of the tasks adds up its
    own right and all answers of every resample, and the parts are added. A null task is a task.
    """
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(task).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("bigint") % PRIME
    per_task = answers.groupBy(task).agg(F.count_if(F.col(correct)).alias("k"), F.count("*").alias("n")).select(number.alias("x"), "k", "n")
    lines, points = np.array(resample_lines(draws, seed), dtype=np.int64), np.array(poisson_points(), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, tasks = np.zeros((2, draws), dtype=np.int64), 0
        for batch in batches:
            x, k, n = (batch.column(c).to_numpy() for c in range(3))
            tasks += len(x)
            for at in range(0, len(x), 1000):
                taken = np.searchsorted(points, (x[at : at + 1000, None] * lines[:, 0] + lines[:, 1]) % PRIME, side="right")
                sums += np.stack([k[at : at + 1000] @ taken, n[at : at + 1000] @ taken])
        if tasks:
            yield pa.RecordBatch.from_pydict({"resample": np.arange(draws), "k": sums[0], "n": sums[1], "tasks": np.full(draws, tasks)})

    parts = per_task.mapInArrow(run, "resample bigint, k bigint, n bigint, tasks bigint")
    totals = parts.groupBy("resample").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum("tasks").alias("tasks"))
    rate = totals.select("tasks", F.try_divide("k", F.nullif("n", F.lit(0))).alias("rate"))
    listed = rate.agg(F.max("tasks").alias("n_tasks"), F.array_sort(F.collect_list("rate")).alias("r"))  # a number a resample
    at = lambda p: F.round(F.get("r", F.floor(p * (F.size("r") - 1)).cast("int")), 6)
    return listed.select(F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"), at(0.025).alias("lo"), at(0.975).alias("hi"))
