import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillspark.operators import selection

NAN = float("nan")


def picked(spark, rows, kind, ranks, **sizes):
    df = spark.createDataFrame(rows, f"g string, v {kind}").repartition(3)
    return {r.g: tuple(r)[1:] for r in selection.select_ranks(df, ["g"], "v", ranks, **sizes).collect()}


RANKS = {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(0.5 * (n - 1)), "high": lambda n: F.floor(0.975 * (n - 1)), "last": lambda n: n - 1}


def plain(values):
    own = sorted((x for x in values if x is not None), key=lambda x: (isinstance(x, float) and math.isnan(x), x))
    n = len(own)
    return (n, *(own[k] for k in (0, math.floor(0.5 * (n - 1)), math.floor(0.975 * (n - 1)), n - 1))) if n else (0, None, None, None, None)


@pytest.mark.parametrize(("bins", "few"), [(200, 20), (4096, 512)])
def test_ranks_of_doubles(spark, bins, few):
    rng = random.Random(2)
    groups = {"even": [rng.random() for _ in range(300)], "wide": [math.exp(rng.uniform(-300, 600)) * rng.choice([-1, 1]) for _ in range(200)], "same": [2.5] * 70, "one": [1.0], None: [rng.gauss(0, 1) for _ in range(50)] + [None] * 9}
    groups |= {"ties": [float(rng.randint(0, 3)) for _ in range(200)], "none": [None, None], "ends": [-1.7e308, 1.7e308, 0.0, 1e-320], "far": [1e15] + [rng.random() * 1e-9 for _ in range(100)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    assert picked(spark, rows, "double", RANKS, bins=bins, few=few) == {g: plain(vs) for g, vs in groups.items()}


def test_large_integers_and_nan(spark):
    top = 2**62
    groups = {"big": [top + k for k in range(40)] + [-top], "ends": [-(2**63), 2**63 - 1, 5]}
    assert picked(spark, [(g, v) for g, vs in groups.items() for v in vs], "bigint", RANKS, bins=30, few=2) == {g: plain(vs) for g, vs in groups.items()}
    got = picked(spark, [("a", NAN), ("a", 1.0), ("a", 2.0), ("b", NAN)], "double", RANKS)["a"]
    assert got[:3] == (3, 1.0, 2.0) and math.isnan(got[4])


def test_medians(spark):
    rng = random.Random(4)
    rows = [(k % 5 or None, rng.randint(0, 1000), None if k % 3 else rng.random()) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, a int, b double")
    got = {r.g: (r.a, r.b) for r in selection.medians(df, ["g"], {"a": F.col("a"), "b": F.col("b")}, 64, 9).collect()}
    assert got == {g: tuple(statistics.median(x for x in c if x is not None) for c in zip(*[r[1:] for r in rows if r[0] == g], strict=True)) for g in (None, 1, 2, 3, 4)}
    assert selection.medians(df, [], {"a": F.col("a")}).first().a == statistics.median(r[1] for r in rows)
    assert selection.medians(df.where("false"), ["g"], {"a": F.col("a")}).collect() == []


def test_a_group_of_a_million_is_not_sorted(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("g"), (F.xxhash64("id") % 100_000_007).alias("v"))
    got = selection.select_ranks(df, ["g"], "v", {"at": lambda n: F.floor(0.975 * (n - 1))})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and got.first().at == df.orderBy("v").offset(math.floor(0.975 * 999_999)).first().v


def test_bootstrap(spark):
    rng = random.Random(8)
    rows = [(f"t{k % 90}", rng.random() < (k % 90) / 90) for k in range(2000)] + [(None, True)]
    df = spark.createDataFrame(rows, "task string, ok boolean")
    got = selection.poisson_bootstrap(df.repartition(7), "task", "ok").first()
    assert got == selection.poisson_bootstrap(df.coalesce(1), "task", "ok").first() and got.n_tasks == 91
    per = {}
    for t, ok in rows:
        a = per.setdefault(t, [0, 0])
        a[0] += ok
        a[1] += 1
    rates = sorted(sum(x[0] for x in s) / sum(x[1] for x in s) for s in (rng.choices(list(per.values()), k=91) for _ in range(4000)))
    assert abs(got.lo - rates[100]) < 0.02 and abs(got.hi - rates[3900]) < 0.02
    none = selection.poisson_bootstrap(df.where("false"), "task", "ok").first()
    assert (none.n_tasks, none.lo, none.hi) == (0, None, None)


def test_poisson_points():
    points = selection.poisson_points()
    mean = sum(k * (b - a) for k, (a, b) in enumerate(zip([0, *points], points, strict=False))) / selection.PRIME
    assert points == sorted(points) and abs(mean - 1) < 1e-6
