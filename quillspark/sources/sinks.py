"""Sinks. Merges overwrite, so doing one twice is doing it once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_ledger(records: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append records, a folder for each type, so that a scan of one type reads no other."""
    records.write.mode("append").partitionBy("type").format(fmt).save(path)


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with sorted keys, without nulls."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))


def merge_ledger(records: DataFrame, path: str) -> None:
    """All records as sorted canonical JSON lines, each once. Sorted by range, not in one task."""
    records.select(canonical_json(records).alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def summary_json(summary: DataFrame, path: str) -> None:
    """A small summary, a JSON object per row, pretty enough to be compared by line."""
    summary.select(canonical_json(summary).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def regraded_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def rejects(rows: DataFrame, path: str) -> bool:
    """Write rejected items, if there are any; says whether."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").json(path)
    return True


def evidence(df: DataFrame, path: str) -> DataFrame:
    """``path, sha256, length`` of untouched files, to show later that they are."""
    files = df.sparkSession.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def write_if_absent(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("ignore").json(path)


def worklist(units: DataFrame, skipped: DataFrame, path: str) -> None:
    """Units to run, and those that are skipped, with their reasons."""
    both = units.withColumn("reason", F.lit(None).cast("string")).unionByName(skipped)
    both.withColumn("skipped", F.col("reason").isNotNull()).write.mode("overwrite").json(path)


def read_worklist(df_or_session, path: str, schema: str) -> DataFrame:
    return df_or_session.read.schema(schema).json(path)


def dictionary(codes: DataFrame, path: str) -> None:
    """``code, kind, text`` by code: the same bytes for the same dictionary."""
    codes.select("code", "kind", "text").orderBy("code").coalesce(1).write.mode("overwrite").json(path)


def payload_text(version: int, coded: Column, report: Column) -> Column:
    """Coded text with its version and report as JSON, so that text of several lines comes back as well."""
    return F.to_json(F.struct(F.lit(version).alias("version"), coded.alias("coded"), report.alias("report")))


def payload_coded(payload: Column) -> Column:
    return F.get_json_object(payload, "$.coded")
