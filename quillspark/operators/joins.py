"""Keyed joins of ledgers. Small sides are broadcast by size, by the optimizer and at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import containment, jaccard, lexical, normalize, token_set
from quillspark.operators.ordering import ranked
from quillspark.sources.scratch import written

PAIR_KEY = ["task_id", "q_index", "question"]
#: Most rows, of a few short columns, of a table that the anchored join broadcasts.
BROADCAST_ROWS = 300_000


def paired(a: DataFrame, b: DataFrame, keys: list[str] = PAIR_KEY, verdict: str = "correct") -> DataFrame:
    """Verdicts ``x`` and ``y`` of the keys that both sides have, each side reduced to its last attempt before."""
    return a.select(*keys, F.col(verdict).alias("x")).join(b.select(*keys, F.col(verdict).alias("y")), keys)


def pivoted(records: DataFrame, key: str, condition: str, value: str, conditions: list[str]) -> DataFrame:
    """A column per condition; one pass instead of self-joins. Several values of a key and condition: the largest."""
    return records.where(F.col(condition).isin(conditions)).groupBy(key).pivot(condition, conditions).agg(F.max(value))


def with_verdicts(answers: DataFrame, judged: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """All answers, those without a judgement as ``unjudged``."""
    return answers.join(judged.select(*keys, verdict), keys, "left").withColumn(verdict, F.coalesce(verdict, F.lit("unjudged")))


def with_similarity(decoded: DataFrame, direct: DataFrame, keys: list[str], a: str, b: str, name: str = "similarity") -> DataFrame:
    """All decoded rows with the Jaccard similarity of their text ``a`` to the direct one's ``b``; one that has no direct
    row, or a null text, is compared with an empty text, which gives 0."""
    both = decoded.join(direct.select(*keys, F.col(b).alias("_direct")), keys, "left")
    sets = [token_set(lexical(F.coalesce(F.col(c), F.lit("")))) for c in (a, "_direct")]
    return both.withColumn(name, jaccard(*sets)).drop("_direct")


def zipped(a: DataFrame, b: DataFrame, order_a: str, order_b: str, names: tuple[str, str]) -> DataFrame:
    """Rows of both sides at the same place of their orders; the longer side's rest goes."""
    left, right = ranked(a, order_a, [], "_place").withColumnRenamed(order_a, names[0]), ranked(b, order_b, [], "_place").withColumnRenamed(order_b, names[1])
    return left.select("_place", names[0]).join(right.select("_place", names[1]), "_place").drop("_place")


def crossed(a: DataFrame, b: DataFrame, excluded: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """All combinations of two small dimensions less the excluded ones."""
    both = a.crossJoin(F.broadcast(b))
    return both if excluded is None else both.join(excluded, keys or [c for c in excluded.columns if c in both.columns], "left_anti")


def anchored(items: DataFrame, passages: DataFrame, item_id: str, item_text: str, passage_id: str, passage_text: str, threshold: float = 0.8) -> DataFrame:
    """Pairs of item and passage whose containment reaches the threshold: ``item_id, passage_id, score``.

    Containment divides by the smaller set, of ``n`` tokens, so it needs ceil(threshold * n) shared ones, and at most
    the others may be missing: one of the smaller set's rarest (others + 1) tokens is shared. Either side is probed
    with those alone, rarest by the number of passages that have them, so a token in all texts joins nothing unless a
    set has hardly any other; of the passages, only those smaller than some item are. Candidates are then counted over all their tokens. Of the passages, only tokens that items
    have are kept, once. Equivalent to comparing all pairs for any threshold above 0.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 would match what shares nothing")
    i = written(_tokens(items, item_id, item_text, "i"), "tokens")
    held = _sent(written(i.select("token").distinct(), "held"))
    p = written(_tokens(passages, passage_id, passage_text, "p").join(held, "token", "left_semi"), "tokens")
    frequent = _sent(written(p.groupBy("token").agg(F.count("*").alias("df")), "frequent"))
    i = written(i.join(frequent, "token"), "tokens")
    every, most = _sent(i.select("i", "i_n", "token")), i.agg(F.max("i_n")).first()[0] or 0
    small_items = p.join(_sent(written(_rarest(i, "i", threshold), "rarest")), "token").where("i_n <= p_n").select("i", "p")
    smaller = p.where(F.col("p_n") < most).join(frequent, "token")  # than some item
    small_passages = _rarest(smaller, "p", threshold).join(every, "token").where("p_n < i_n").select("i", "p")
    found = _sent(written(small_items.unionByName(small_passages).distinct(), "pairs"))
    counted = p.join(found, "p").join(every, ["i", "token"])
    counted = counted.groupBy("i", "p", F.least("i_n", "p_n").alias("least")).agg(F.count("*").alias("shared"))
    scored = counted.withColumn("score", F.col("shared") / F.col("least")).where(F.col("score") >= threshold)
    return scored.select(F.col("i").alias(item_id), F.col("p").alias(passage_id), F.round("score", 6).alias("score"))


def _sent(stored: DataFrame) -> DataFrame:
    """A stored table, broadcast if it has few rows, so that the tokens of passages aren't shuffled to meet it."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def _tokens(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """A row per token (``name``, ``name_n``: the size of the set, ``token``); each text is tokenised once."""
    tokens = token_set(normalize(F.coalesce(F.col(text), F.lit(""))))
    held = df.select(F.col(key).alias(name), F.explode(F.array(tokens)).alias("t"))  # keeps the set from being computed again
    return held.select(name, F.size("t").alias(f"{name}_n"), F.explode("t").alias("token"))


def _rarest(tokens: DataFrame, name: str, threshold: float) -> DataFrame:
    """Of each set, the rarest tokens one of which is shared with any set that contains enough of it.

    ``tokens`` has only those that both sides have; the others are missing in any case. Sets that miss too many go.
    """
    own = Window.partitionBy(name)
    spare = F.col(f"{name}_n") - F.ceil(F.col(f"{name}_n") * threshold - 1e-9) - (F.col(f"{name}_n") - F.count("*").over(own))
    ranked = tokens.withColumn("spare", spare).withColumn("place", F.row_number().over(own.orderBy("df", "token")))
    return ranked.where(F.col("place") <= F.col("spare") + 1).select(name, f"{name}_n", "token")


def gate(items: DataFrame, passage: str, expected: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Items whose expected answer is anchored in their passage, and the others with their scores."""
    sets = [token_set(normalize(F.coalesce(F.col(c), F.lit("")))) for c in (expected, passage)]
    scored = items.withColumn("anchor_score", containment(*sets))
    return scored.where(F.col("anchor_score") >= threshold), scored.where(F.col("anchor_score") < threshold)


def stamped(records: DataFrame, stamp: dict[str, Column]) -> DataFrame:
    """Run metadata on every record; a record's own value wins."""
    return records.withColumns({k: F.coalesce(F.col(k), v) if k in records.columns else v for k, v in stamp.items()})


def disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    return a.select(*keys).intersect(b.select(*keys)).isEmpty()
