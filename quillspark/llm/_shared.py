"""Scratch tables, size-checked joins and Arrow plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import operator
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.scratch import scratch_root

#: Most rows, and bytes of their values, that ``sized_join`` broadcasts; above either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000

_tables: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    path = f"{scratch_root(df.sparkSession)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_quill_path", None)
        if path and _tables.pop(path, None):
            _delete(t.sparkSession, path)


def tables() -> set[str]:
    """Paths of the tables made by ``written`` that are still there."""
    return set(_tables)


def discard_since(before: set[str], *kept: DataFrame) -> None:
    """Delete the tables made since, but for those kept, of which nothing will be read again."""
    for path in set(_tables) - before - {getattr(t, "_quill_path", None) for t in kept}:
        _delete(_tables.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_tables.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            return
    _tables.clear()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _weight(df: DataFrame) -> Column:
    """Bytes of a row, about: 16 a plain value, and the lengths of texts and arrays."""
    sizes = [F.lit(16 * len(df.columns)).cast("bigint")]
    for f, c in zip(df.schema.fields, own_columns(df), strict=True):
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.octet_length(c))
        elif kind in ("array", "map"):
            sizes.append(16 * F.greatest(F.size(c), F.lit(0)))
        elif kind == "struct":
            sizes.append(F.octet_length(F.to_json(c)))
    return functools.reduce(operator.add, [F.coalesce(x, F.lit(0)).cast("bigint") for x in sizes])


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``small`` broadcast if it has at most ``rows`` rows and ``BROADCAST_BYTES`` (counted), shuffled beyond."""
    n, weight = small.select(_weight(small).alias("w")).limit(rows + 1).agg(F.count("*"), F.sum("w")).first()
    return big.join(F.broadcast(small) if n <= rows and (weight or 0) <= BROADCAST_BYTES else small, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_q_{n}"
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 1 by ``order``: ranges of rows are sorted where they are, and get what comes before them added.

    Rows that are equal in ``order`` are told apart by their place, so even a third of all rows with one key is cut into
    ranges. The driver holds a number for each range.
    """
    tie, place = fresh(df, "tie", "place")
    order = [*order, F.col(tie)]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop(tie)
    ranged = written(ranged.withColumn(place, F.monotonically_increasing_id()), "ranges")  # its range in the high bits, its row in the low 33
    part = F.shiftright(place, 33)
    before, offsets = 0, []
    for k, n in sorted(ranged.groupBy(part.alias("k")).count().collect()):
        offsets.append((k, before))
        before += n
    (at,) = fresh(ranged, "before")
    starts = df.sparkSession.createDataFrame(offsets, f"k bigint, {at} bigint")
    own = ranged.join(F.broadcast(starts), part == F.col("k"))
    return own.withColumn(name, F.col(at) + F.col(place) - F.shiftleft(part, 33) + 1).drop("k", at, place)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def squeezed(x: bytes, level: int = 1) -> bytes:
    """Compressed bytes, with their number in front."""
    return len(x).to_bytes(5, "little") + pa.Codec("zstd", level).compress(x, asbytes=True)


def loosened(x: bytes) -> bytes:
    return pa.decompress(x[5:], int.from_bytes(x[:5], "little"), codec="zstd", asbytes=True)


def packed(x: np.ndarray, width: int = 4, level: int = 1) -> bytes:
    """Numbers of ``width`` bytes, compressed: all lowest bytes first, so that small numbers take little."""
    return squeezed(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), level)


def unpacked(x: bytes, width: int = 4) -> np.ndarray:
    thin = np.frombuffer(loosened(x), dtype=np.uint8)
    return np.ascontiguousarray(thin.reshape(width, -1).T).reshape(-1).view(f"<u{width}").astype(np.int64 if width < 8 else np.uint64)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with one key (bigint), of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        own = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                if held and own[x] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(x, y - x))
                last = own[x]
    if held:
        yield pa.Table.from_batches(held)


def trim() -> None:
    """Give freed memory back at the end of a partition: Python workers are used again and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 8_000_000):
    """Cut a batch so that each slice has about ``most_bytes`` of the string column at most, a row at least."""
    start, total = 0, 0
    arr = batch.column(column)
    sizes = pa.compute.binary_length(arr).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
