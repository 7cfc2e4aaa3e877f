import os

from pyspark.sql import functions as F

from quillspark.operators import aggregates, ordering
from quillspark.sources.runs import RunStore, put_slices, slice_summary


def collected(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_a_slice_is_replaced(spark, tmp_path):
    path = str(tmp_path / "sums")
    rows = spark.range(3000).select((F.col("id") % 5).alias("slice"), (F.col("id") % 3).cast("string").alias("lang"), F.when(F.col("id") % 7 > 0, F.col("id") % 4).alias("source"), (F.col("id") % 11 < 6).alias("correct"))
    put_slices(rows.where("slice < 4"), path, "slice", ["lang", "source"])
    put_slices(rows.where("slice = 4").limit(17), path, "slice", ["lang", "source"])
    other = {f: os.stat(f"{path}/slice=1/{f}").st_mtime_ns for f in os.listdir(f"{path}/slice=1")}
    for _ in range(2):  # the slice is run again, twice
        put_slices(rows.where("slice = 4"), path, "slice", ["lang", "source"])
    want = aggregates.accuracy_by_grain(rows, ["lang", "source"])
    columns = ["grain", "key", "n", "correct", "accuracy", "wilson_lo", "wilson_hi"]
    assert collected(slice_summary(spark, path, ["lang", "source"]), *columns) == collected(want, *columns)
    assert other == {f: os.stat(f"{path}/slice=1/{f}").st_mtime_ns for f in os.listdir(f"{path}/slice=1")}


def test_appends_and_compaction(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 120).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") * 7919 % 1000).alias("at"), F.col("id").alias("v"))
    store = RunStore(spark, str(tmp_path / "runs"), ["k"], ["at", "v"], buckets=8)
    for run in range(3):
        store.append(rows.where(F.col("v") % 3 == run), run)
        store.append(rows.where(F.col("v") % 3 == run), run)  # again: replaces itself
    want = collected(ordering.last_attempt(rows, ["k"], ["at", "v"]), "k", "at", "v")
    assert collected(store.read(), "k", "at", "v") == want and store.crowded() == list(range(8))
    assert store.compact() == list(range(8)) and store.crowded() == [] and store.compact() == []
    assert collected(store.read(), "k", "at", "v") == want and store.runs().count() == 120
    one = rows.where("k = 5").limit(1).withColumn("at", F.lit(5000).cast("bigint"))
    store.append(one, 9)
    touched = store.crowded()
    assert len(touched) == 1 and store.read().where("k = 5").first()["at"] == 5000
    plan = store.runs(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert all(f"/bucket={touched[0]}/" in f for f in [r.f for r in store.runs(touched).select(F.input_file_name().alias("f")).distinct().collect()])
    assert store.compact() == touched and store.read().count() == 120


def test_keys_may_be_null_and_a_run_empty(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), ["k"], ["at"])
    store.append(spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, None, "c")], "k int, at int, v string"), 0)
    store.append(spark.createDataFrame([], "k int, at int, v string"), 1)
    store.append(spark.createDataFrame([(1, None, "later run")], "k int, at int, v string"), 2)
    assert collected(store.read(), "k", "v") == ["Row(k=1, v='later run')", "Row(k=None, v='b')"]
