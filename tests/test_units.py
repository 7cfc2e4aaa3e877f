import random

from pyspark.sql import functions as F

from quillspark.operators import ordering
from quillspark.plans import experiment
from quillspark.streaming import units


def test_results_are_those_of_the_batch(spark):
    rng = random.Random(6)
    levels = [(u, level, rng.choice([None, *range(8, 14)]), 11) for u in range(60) for level in rng.sample(range(1, 6), rng.randint(1, 5)) for _ in range(rng.choice([1, 1, 2]))]
    got = sorted((u, *units.brake([list(x[1:]) for x in levels if x[0] == u])) for u in range(60))
    df = spark.createDataFrame([(u, x, None if s is None else float(s), float(b)) for u, x, s, b in levels], "u int, level int, s double, b double")
    assert got == sorted(tuple(r) for r in ordering.brake(df, ["u"], "level", "s", "b").collect())
    checks = [(u, r, rng.random() < 0.8, rng.randint(0, 3), rng.choice([0, 3])) for u in range(80) for r in rng.sample(range(4), rng.randint(1, 4))]
    df = spark.createDataFrame(checks, "task_id int, round int, parse_ok boolean, matched int, total int").withColumn("arm", F.lit("a"))
    want = {r.task_id: (r.state, r.recall_pre, r.recall_post, r.repairs) for r in experiment.repairs(df, 2).collect()}
    for u in want:
        rounds = [list(x[1:]) for x in checks if x[0] == u]
        assert units.repairs(2)(rounds) == units.repairs(2)(rounds[::-1]) and (units.repairs(2)(rounds) == want[u] or units.repairs(2)(rounds)[3] is None)


def test_a_unit_expires(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", 2, 5.0, "2026-01-01 00:00:00"), ("b", 1, 20.0, "2026-01-01 00:00:00")], [("a", 1, 20.0, "2026-01-01 00:10:00")], [("c", 1, 20.0, "2026-01-05 00:00:00")], [("c", 2, 20.0, "2026-01-05 00:00:01")]]
    for rows in batches:
        spark.createDataFrame([(k, n, s, 11.0, t) for k, n, s, t in rows], "k string, n int, s double, b double, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        found = units.decided(stream, ["k"], "n", ["s", "b"], "ts", units.brake, units.BRAKE, "1 minute", 60_000)
        units.put_updates(found, out, str(tmp_path / "state")).awaitTermination()
    rows = {r.k: r for r in units.latest(spark.read.parquet(out), ["k"]).collect()}
    assert (rows["a"].chosen, rows["a"].stopped_at, rows["a"].accepted, rows["a"].final) == (1, 2, 1, True)
    assert rows["b"].final and not rows["c"].final and (rows["c"].chosen, rows["c"].accepted) == (2, 2)


def test_a_call_handles_many_units(spark, tmp_path, monkeypatch):
    """Units share the calls of their bucket, and keys come back as they were, null or beyond 2 ** 53."""
    monkeypatch.setattr(units, "BUCKETS", 2)
    rows = [(k, n, 20.0, 11.0) for k in [None, 2**60 + 1, *range(50)] for n in (1, 2)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, "k bigint, n int, s double, b double").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    df.repartition(3, "n").write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = units.put_updates(units.decided(stream, ["k"], "n", ["s", "b"], "ts", units.brake, units.BRAKE), out, str(tmp_path / "state"))
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) == 2
    got = {r.k: (r.chosen, r.stopped_at, r.accepted) for r in units.latest(spark.read.parquet(out), ["k"]).collect()}
    assert got == {k: (2, None, 2) for k in [None, 2**60 + 1, *range(50)]}


def test_checks_take_one_exchange(spark, sf_dir):
    """Rounds are numbered and gathered where an order's line items have met."""
    from quillspark.plans import stored

    plan = stored._checks(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
