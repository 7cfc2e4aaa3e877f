"""Greedy removal of near duplicates within a group, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import lexical, token_set

OVERLAP = 0.6


def _shared(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set, 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def greedy(items: DataFrame, keys: list[str], order: str, text: str, threshold: float = OVERLAP) -> DataFrame:
    """Judge the items of each group in order: one goes if it overlaps an earlier item that was kept.

    An item that goes blocks none, so a plain self-join would be wrong for chains. Returns the keys, ``order``, ``kept``,
    ``kept_index`` (place among the kept items of the first one that blocks it, null for kept ones) and ``overlap``.
    Groups are small by nature (the items of one passage) and are folded by a higher-order function in the JVM.
    """
    tokens = token_set(lexical(F.coalesce(F.col(text), F.lit(""))))
    grouped = items.select(*keys, F.struct(F.col(order).alias("pos"), tokens.alias("tokens")).alias("item"))
    grouped = grouped.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
    kind = dict(items.select(F.col(order).alias("pos")).dtypes)["pos"]
    start = F.expr(f"named_struct('kept', cast(array() as array<array<string>>), 'out', cast(array() as array<struct<pos:{kind},kept:boolean,kept_index:int,overlap:double>>))")

    def step(acc: Column, item: Column) -> Column:
        scores = F.transform(acc["kept"], lambda k: _shared(item["tokens"], k))
        first = F.array_position(F.transform(scores, lambda s: s >= threshold), True).cast("int")
        kept = first == 0
        out = F.struct(
            item["pos"].alias("pos"), kept.alias("kept"), F.when(~kept, first - 1).alias("kept_index"), F.when(~kept, F.try_element_at(scores, first)).alias("overlap")
        )
        return F.struct(F.when(kept, F.concat(acc["kept"], F.array(item["tokens"]))).otherwise(acc["kept"]).alias("kept"), F.concat(acc["out"], F.array(out)).alias("out"))

    judged = grouped.select(*keys, F.explode(F.aggregate("items", start, step)["out"]).alias("o"))
    return judged.select(*keys, F.col("o.pos").alias(order), "o.kept", "o.kept_index", F.round("o.overlap", 6).alias("overlap"))


def positional_types(items: DataFrame, array: str, declared: str, allowed: list[str], fallback: list[str]) -> DataFrame:
    """Explode an array of structs and repair what isn't an allowed type by the item's position."""
    rows = items.select("*", F.posexplode(array).alias("pos", "item"))
    by_position = F.try_element_at(F.array(*map(F.lit, fallback)), F.col("pos") + 1)
    own = F.col(f"item.{declared}")
    return rows.withColumn("repaired_type", F.when(own.isin(allowed), own).otherwise(by_position)).withColumn("repaired", ~F.coalesce(own.isin(allowed), F.lit(False)))


def valid_items(items: DataFrame, array: str) -> DataFrame:
    """Items with a non-empty question and answer."""
    return items.withColumn(array, F.filter(array, lambda x: (F.coalesce(x["q"], F.lit("")) != "") & (F.coalesce(x["a"], F.lit("")) != "")))


def deficits(items: DataFrame, key: str, kind: str, quotas: dict[str, int], groups: DataFrame) -> DataFrame:
    """Groups that miss a quota (a minimum, no cap): ``key, kind, have, want``. Groups without items are counted too."""
    want = groups.select(key).distinct().select(key, F.explode(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])).alias(kind, "want"))
    have = items.groupBy(key, kind).agg(F.count("*").alias("have"))
    return want.join(have, [key, kind], "left").select(key, kind, F.coalesce("have", F.lit(0)).alias("have"), "want").where("have < want")
