"""Order-dependent operators. Order always comes from columns, never from the place of a row in a file."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.stats import hash_number, place_in, tile
from quillspark.sources.scratch import written


def indexed(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "q_index") -> DataFrame:
    """Number the rows of each key from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def last_attempt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order`` (nulls first): one aggregation with partial maxima, no sort.

    A key with a third of all rows costs each task its share only.
    """
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])).alias("_last"))
    return latest.select(*keys, "_last.*").select(*df.columns)


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key; a group limit is pushed below the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def duplicate_keys(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys that stand for more than one payload, which makes "last wins" a silent choice."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*payload)).alias("n_payloads"))
    return counts.where("n_payloads > 1")


def sliced(df: DataFrame, order: list[str], offset: int, length: int) -> DataFrame:
    """Rows offset..offset+length in order. Out of range, or empty, is an error, so that no slice is lost unseen."""
    total = df.count()
    if not 0 <= offset < total or length <= 0:
        raise ValueError(f"slice {offset}+{length} of {total} rows")
    return df.orderBy(*order).offset(offset).limit(length)


def tiles(df: DataFrame, slots: int) -> DataFrame:
    """``slot, offset, length`` of an exact tiling of all rows."""
    totals = df.agg(F.count("*").alias("total"))
    slot = df.sparkSession.range(slots).withColumnRenamed("id", "slot").crossJoin(F.broadcast(totals))
    at, n = tile(F.col("slot"), slots, F.col("total"))
    return slot.select("slot", at.alias("offset"), n.alias("length"))


#: Rows that one task numbers, about, in ``ranked``.
RANGE_ROWS, MOST_RANGES = 1_000_000, 10_000


def ranked(df: DataFrame, order: str, ties: list[str], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Number all rows from 0 by a numeric or time column (nulls first), then ``ties``, without sorting them in one task.

    Quantiles of the column, computed once, cut it into ranges; rows are numbered within their range, and a small
    table adds the number of rows in the ranges before. Equal values share a range, however many there are.
    """
    ranges = max(1, min(MOST_RANGES, math.ceil(df.count() / range_rows)))
    cuts = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * max(1000, ranges))).first()[0] if ranges > 1 else None
    cuts = sorted(set(cuts or []))
    parts = df.withColumn("_range", F.coalesce(place_in(F.col(order), cuts), F.lit(-1)))
    counts = parts.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order, *ties)) - 1
    return parts.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Number all rows from 0 by columns of any type. Ranges of rows are sorted where they lie and get the number of rows
    before them added; rows that are equal in ``order`` are told apart by their place, so no key is too frequent to be cut.
    """
    order = [*order, F.col("_tie")]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    ranged = written(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranges")  # its range in the high bits, its row in the low 33
    part = F.shiftright("_place", 33)
    before, starts = 0, []
    for k, n in sorted(ranged.groupBy(part.alias("k")).count().collect()):  # a row a range
        starts.append((k, before))
        before += n
    own = ranged.join(F.broadcast(df.sparkSession.createDataFrame(starts, "_k bigint, _before bigint")), part == F.col("_k"))
    return own.withColumn(name, F.col("_before") + F.col("_place") - F.shiftleft(part, 33)).select(*df.columns, name)


def split_sessions(df: DataFrame, session: str, order: str, name: str = "part") -> DataFrame:
    """Mark each row ``train`` or ``test`` by the parity of its session's place in the order of first appearance.

    The rank is taken over sessions, not rows, and joined back; no session is on both sides. ``order`` is a number or
    a time.
    """
    firsts = df.groupBy(session).agg(F.min(order).alias("_first"))
    part = F.when(F.col("_rank") % 2 == 0, "train").otherwise("test")
    return df.join(ranked(firsts, "_first", [session], "_rank").select(session, part.alias(name)), session)


def hash_sample(df: DataFrame, key: Column, k: int, seed: str) -> DataFrame:
    """k rows without replacement, by a seeded hash of their key: the same rows in any engine and any partitioning."""
    return df.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))).orderBy("_draw", key).limit(k).drop("_draw")


def first_distinct(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Each value once, with ``_first``: its place in the order of first appearance. Minima combine before the shuffle."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("_first")).orderBy("_first")


def follows(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))


def brake(levels: DataFrame, keys: list[str], level: str, score: str, baseline: str, slack: float = 1) -> DataFrame:
    """The last level of each unit before the first whose score falls below baseline - slack.

    Adds to the keys: ``chosen`` (0 stands for the original), ``stopped_at`` (null if none failed), ``accepted``.
    """
    upto = Window.partitionBy(*keys).orderBy(level)  # a range frame: rows of one level stand or fall together
    ok = (F.col(score) >= F.col(baseline) - slack).cast("int")
    run = levels.withColumn("_ok", F.coalesce(ok, F.lit(0))).withColumn("_all", F.min("_ok").over(upto))
    return run.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_all") == 1, F.col(level))), F.lit(0)).alias("chosen"), F.min(F.when(F.col("_ok") == 0, F.col(level))).alias("stopped_at"),
        F.count_if(F.col("_all") == 1).alias("accepted"),
    )


def draw(seed: str, key: Column, n: Column) -> Column:
    """A number from 0 to n - 1 by a seeded hash."""
    return F.pmod(hash_number(F.concat(F.lit(f"{seed}:"), key.cast("string"))), n)
