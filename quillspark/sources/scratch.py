"""Folders for stored fixtures: in the shared folder of the cluster, deleted when the session ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []

#: Temporary folders of local sessions that name no shared one, by application.
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a temporary one only where the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quillspark-")
        root = _own[app]
    return root.rstrip("/")


def _system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: the rows, stored as Parquet and read again, so that what uses them more than once makes them once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_files(lines: DataFrame, path: str, names: list[str]) -> str:
    """Write ``lines`` (columns ``file``, a number, and ``value``) as a text file for each name, and return the folder."""
    spark = lines.sparkSession
    lines.select("file", "value").repartition(len(names), "file").write.partitionBy("file").text(f"{path}-parts")
    where, fs = _system(spark, f"{path}-parts")
    target, _ = _system(spark, path)
    fs.mkdirs(target)
    for status in fs.globStatus(_system(spark, f"{path}-parts/file=*/part-*")[0]):
        place = status.getPath()
        at = int(place.getParent().getName().split("=")[1])
        fs.rename(place, _system(spark, f"{path}/{names[at]}")[0])
    fs.delete(where, True)
    return path


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            p, fs = _system(spark, path)
            fs.delete(p, True)
