"""Dictionary build: mine, scan, select, validate, and verify that every frame comes back."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import legend
from quillspark.operators import mining
from quillspark.operators.codec import frame_codec, invalid_codes


class DictionaryError(ValueError):
    """A dictionary that isn't unique or doesn't bring every frame back."""


@dataclass
class Dictionary:
    frames: DataFrame  # text, code
    segments: DataFrame  # code, segment, freq, saving, legend, projected
    chosen: list[dict]

    def segment_codes(self) -> dict[str, str]:
        return {x["segment"]: x["code"] for x in self.chosen}

    def codes(self) -> DataFrame:
        """``code, kind, text`` of both kinds."""
        whole = self.frames.select("code", F.lit("frame").alias("kind"), "text")
        return whole.unionByName(self.segments.select("code", F.lit("segment").alias("kind"), F.col("segment").alias("text")))

    def legend_text(self) -> DataFrame:
        """One row: ``segment_legend``, ``frame_legend``."""
        both = self.codes().groupBy().agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("code", "text"))).alias(k) for k in ("segment", "frame")])
        return both.select(legend(F.col("segment"), "segment").alias("segment_legend"), legend(F.col("frame"), "frame").alias("frame_legend"))


def build(frames: DataFrame, text: str, order: str, test: int = 0, min_chars: int = mining.MIN_CHARS, min_freq: int = mining.MIN_FREQ, most_candidates: int = mining.MAX_CANDIDATES) -> Dictionary:
    """Build from training frames only; ``test`` is the number of frames that the dictionary is projected to serve.

    Counting, scanning and sorting are distributed, over distinct texts with weights. The greedy selection is one pass
    over the occurrences in the order of their segments: the driver holds the candidates (capped), the occurrences of
    one of them, and the spans that chosen segments (as many as there are codes) take.
    """
    texts = mining.weighted_texts(frames, text)
    numbered = texts.withColumn("id", F.xxhash64("text"))
    train = frames.where(F.col(text).isNotNull()).count()
    patterns = [r.segment for r in mining.candidates(frames, text, min_chars, min_freq, most_candidates).collect()]
    patterns.sort(key=lambda s: (-len(s), s))
    hits = mining.scan(numbered, "id", "text", patterns).join(numbered.select("id", "weight"), "id")
    hits = hits.groupBy("pattern", "id", "weight").agg(F.array_sort(F.collect_list("start")).alias("starts")).orderBy("pattern", "id")
    by_pattern = groupby(hits.toLocalIterator(prefetchPartitions=True), key=lambda r: r.pattern)
    chosen = mining.select(patterns, ((k, ((r.id, r.weight, r.starts) for r in rows)) for k, rows in by_pattern), train, test, min_freq)
    faults = invalid_codes(x["code"] for x in chosen)
    if faults:
        raise DictionaryError("; ".join(faults))
    spark = frames.sparkSession
    segments = spark.createDataFrame([tuple(x.values()) for x in chosen], "code string, segment string, freq bigint, saving int, legend int, projected double")
    return Dictionary(mining.frame_codes(frames, text, [order]), segments, chosen)


def failures(frames: DataFrame, text: str, dictionary: Dictionary, whole_frames: dict[str, str] | None = None) -> DataFrame:
    """Frames that don't come back from their code: none, or the dictionary is of no use."""
    encode, decode = frame_codec(whole_frames or {}, dictionary.segment_codes())
    return frames.withColumn("back", decode(encode(F.col(text)))).where(F.col("back") != F.col(text))


def check(frames: DataFrame, text: str, dictionary: Dictionary) -> None:
    if not failures(frames, text, dictionary).isEmpty():
        raise DictionaryError("a frame doesn't come back")


def code_faults(codes: DataFrame) -> DataFrame:
    """Codes that begin the next one in order, or are there twice; neighbours are compared within their first two letters."""
    after = F.lead("code").over(Window.partitionBy(F.substring("code", 1, 2)).orderBy("code"))
    return codes.withColumn("after", after).where(F.startswith("after", F.col("code"))).select("code", "after")
