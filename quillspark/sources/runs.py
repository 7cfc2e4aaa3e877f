"""Stores that are updated in parts: partial aggregates by slice, and ledgers as small runs of key buckets.

Both replace whole partitions, so doing an update twice is doing it once, and an update costs what it touches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import stats
from quillspark.operators.ordering import last_attempt
from quillspark.sources.scratch import _system, written


def put_slices(answers: DataFrame, path: str, slice_id: str, by: list[str], correct: str = "correct") -> None:
    """Add up the answers of each slice by ``by`` (a row for each combination) and put them in place of what the store had of
    the slices that these answers are of. Other slices are neither read nor written."""
    sums = answers.groupBy(slice_id, *by).agg(*stats.accuracy_block(F.col(correct)))
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(slice_id).parquet(path)


def slice_summary(spark: SparkSession, path: str, grains: list[str]) -> DataFrame:
    """``grain, key, n, correct``, accuracy and bounds over all slices, from their sums: no answer is read again."""
    sums = spark.read.parquet(path)
    grouped = sums.groupingSets([[], *[[F.col(g)] for g in grains]], *[F.col(g) for g in grains])
    rows = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"), *[F.grouping(g).alias(f"_g_{g}") for g in grains])
    which = reduce(lambda acc, g: F.when(F.col(f"_g_{g}") == 0, F.lit(g)).otherwise(acc), reversed(grains), F.lit("overall"))
    key = reduce(lambda acc, g: F.when(F.col(f"_g_{g}") == 0, F.col(g).cast("string")).otherwise(acc), reversed(grains), F.lit(None).cast("string"))
    return stats.with_accuracy(rows.select(which.alias("grain"), key.alias("key"), "n", "correct"))


#: Buckets of keys, each a folder: as many as keep a bucket's rows within a task.
BUCKETS = 16


class RunStore:
    """Records by key, appended as runs. The last write of a key counts: of the latest ``order``, then of the latest run.

    A run holds rows of the buckets that it touches, each in a folder of its own, and is numbered by its caller: a run
    that is written again replaces itself. Reading takes the last row of each key over all runs; compaction turns the
    runs of some buckets into one, and reads and writes these buckets only.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def append(self, rows: DataFrame, run: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = rows.withColumns({"bucket": bucket, "run": F.lit(run)})
        put = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(*self.keys), F.lit(7)))  # a bucket of many rows goes to several tasks
        put.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run").parquet(self.path)

    def runs(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows of all runs, or those of some buckets: the others' folders aren't listed as input."""
        rows = self.spark.read.parquet(self.path)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        return last_attempt(self.runs(buckets), self.keys, [*self.order, "run"]).drop("bucket", "run")

    def crowded(self, most: int = 1) -> list[int]:
        """Buckets with more than ``most`` runs, from the names of folders: no row is read."""
        return sorted(b for b, runs in self._folders().items() if len(runs) > most)

    def _folders(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        place, fs = _system(self.spark, f"{self.path}/bucket=*/run=*")
        for status in fs.globStatus(place) or []:
            bucket, run = (int(x.split("=")[1]) for x in status.getPath().toString().rsplit("/", 2)[1:])
            out.setdefault(bucket, []).append(run)
        return out

    def compact(self, most: int = 1) -> list[int]:
        """Make one run, the latest number of each, of the runs of crowded buckets; the buckets that were touched.

        The merged rows are stored apart, then replace the latest run, then the earlier runs go: if it stops at any point,
        what is left reads the same, and compaction can be done again.
        """
        folders = {b: runs for b, runs in self._folders().items() if len(runs) > most}
        if not folders:
            return []
        merged = written(last_attempt(self.runs(sorted(folders)), self.keys, [*self.order, "run"]), "compacted")
        latest = F.create_map(*[F.lit(x) for b, runs in folders.items() for x in (b, max(runs))])
        put = merged.withColumn("run", F.element_at(latest, F.col("bucket"))).repartition(F.col("bucket"), F.pmod(F.xxhash64(*self.keys), F.lit(7)))
        put.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run").parquet(self.path)
        for bucket, runs in folders.items():
            for run in runs:
                if run != max(runs):
                    place, fs = _system(self.spark, f"{self.path}/bucket={bucket}/run={run}")
                    fs.delete(place, True)
        return sorted(folders)
