"""Dictionary mining: candidate segments, multi-pattern scan, greedy non-overlapping selection.

Candidates and their frequencies are counted by distributed aggregation; the scan runs an automaton of the capped
candidates over each partition; only the selection, which is sequential by definition, runs in one place, over a stream
of occurrences sorted by candidate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import field_count, json_tokens
from quillspark.operators.codec import token_cost
from quillspark.sources.scratch import written

#: Bounds of candidates and of the code space.
MIN_CHARS, MIN_FIELDS, MIN_FREQ, MAX_CANDIDATES, MAX_SPAN, MAX_EDGE, EDGE_CHARS = 12, 3, 5, 20_000, 10, 64, 4000
FRAME_CODES, SHORT_CODES, LONG_CODES = 9999, 99, 999


def weighted_texts(frames: DataFrame, text: str) -> DataFrame:
    """Distinct texts with the number of frames that have each, so that mining reads every text once."""
    return frames.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("weight"))


def span_candidates(texts: DataFrame, min_chars: int = MIN_CHARS, max_span: int = MAX_SPAN) -> DataFrame:
    """``segment`` and ``freq`` (weighted number of texts): spans of 2 to ``max_span`` JSON tokens that are long enough or
    have enough fields. Texts that JSON tokens don't tile have none."""
    tokens = texts.select("text", "weight", json_tokens("text").alias("tokens")).where("tokens is not null")
    starts = tokens.select("text", "weight", "tokens", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens") - 1))).alias("i"))
    spans = starts.withColumn("n", F.explode(F.sequence(F.lit(2), F.lit(max_span)))).where("i + n - 1 <= size(tokens)")
    part = F.slice("tokens", F.col("i"), F.col("n"))
    spans = spans.select("text", "weight", F.array_join(part, "").alias("segment"), field_count(part).alias("fields"))
    return _frequencies(spans.where((F.length("segment") >= min_chars) | (F.col("fields") >= MIN_FIELDS)))


def edge_candidates(texts: DataFrame, min_chars: int = MIN_CHARS, max_edge: int = MAX_EDGE, min_freq: int = 1, edge_chars: int | None = EDGE_CHARS) -> DataFrame:
    """``segment`` and ``freq``, of ``min_freq`` at least: beginnings and ends, of 12 to 64 characters, of texts that JSON tokens don't
    tile. ``texts`` are distinct. Ends are those of whole texts if ``edge_chars`` is None, else of so many characters from the
    beginning, as in the reference; the queries and ``candidates`` take whole texts.

    A frequent segment has half of its frequency as a beginning or as an end, so the first ``min_chars`` characters of those
    beginnings, or the last of those ends, have that too. Only texts that share such an edge, and those whose other edge can
    meet a segment of theirs, offer segments; each offers a segment once, so segments are summed without their texts.
    """
    head = F.col("text") if edge_chars is None else F.substring("text", 1, edge_chars)
    head = texts.where(json_tokens("text").isNull()).select(head.alias("head"), "weight").where(F.length("head") >= min_chars)
    edges = head.select(F.left("head", F.lit(max_edge)).alias("first"), F.right("head", F.lit(max_edge)).alias("last"), "weight")
    begins, ends = F.lit(True), F.lit(True)
    if (half := -(-min_freq // 2)) > 1:
        edges = written(edges.withColumns({"begin": F.left("first", F.lit(min_chars)), "end": F.right("last", F.lit(min_chars))}), "edges")
        common = {c: edges.groupBy(c).agg(F.sum("weight").alias("n")).where(F.col("n") >= half).select(c) for c in ("begin", "end")}
        places = lambda c: F.sequence(F.lit(1), F.length(c) - min_chars + 1)
        grams = lambda c: F.explode(F.transform(places(c), lambda i: F.substring(F.col(c), i, F.lit(min_chars))))
        met = {
            "end": edges.join(common["begin"], "begin", "left_semi").select(grams("first").alias("end")),  # how beginnings end
            "begin": edges.join(common["end"], "end", "left_semi").select(grams("last").alias("begin")),
        }
        for c in ("begin", "end"):
            edges = edges.join(common[c].unionByName(met[c]).distinct().withColumn(f"has_{c}", F.lit(True)), c, "left")
        begins, ends = F.col("has_begin"), F.col("has_end")
        edges = edges.where(begins | ends)
    sized = edges.withColumn("n", F.explode(F.sequence(F.lit(min_chars), F.length("first"))))
    both = F.array_compact(F.array(F.when(begins, F.left("first", F.col("n"))), F.when(ends, F.right("last", F.col("n")))))
    offered = sized.select("weight", F.explode(F.array_distinct(both)).alias("segment"))
    return offered.groupBy("segment").agg(F.sum("weight").alias("freq")).where(F.col("freq") >= min_freq)


def _frequencies(spans: DataFrame) -> DataFrame:
    return spans.groupBy("segment", "text").agg(F.max("weight").alias("weight")).groupBy("segment").agg(F.sum("weight").alias("freq"))


def candidates(frames: DataFrame, text: str, min_chars: int = MIN_CHARS, min_freq: int = MIN_FREQ, most: int = MAX_CANDIDATES) -> DataFrame:
    """The ``most`` frequent enough segments with the largest length * freq, ties by segment."""
    texts = weighted_texts(frames, text)
    found = span_candidates(texts, min_chars).unionByName(edge_candidates(texts, min_chars, min_freq=min_freq, edge_chars=None)).groupBy("segment").agg(F.max("freq").alias("freq"))
    return found.where(F.col("freq") >= min_freq).orderBy(F.desc(F.length("segment") * F.col("freq")), "segment").limit(most)


def scan(texts: DataFrame, id_col: str, text_col: str, patterns: list[str]) -> DataFrame:
    """Every occurrence, overlapping ones too, of every pattern in one pass: ``id_col``, ``pattern`` (its number), ``start``.

    The automaton is built once per task; patterns are bounded by the cap on candidates.
    """
    import ahocorasick

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            automaton.add_word(p, i)
        if patterns:
            automaton.make_automaton()
        for batch in batches:
            ids, which, starts = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for end, k in automaton.iter(t) if t and patterns else ():
                    ids.append(i)
                    which.append(k)
                    starts.append(end - len(patterns[k]) + 1)
            yield pa.RecordBatch.from_pydict({id_col: pa.array(ids, batch.schema.field(0).type), "pattern": pa.array(which, pa.int32()), "start": pa.array(starts, pa.int32())})

    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {texts.schema[id_col].dataType.simpleString()}, pattern int, start int")


def segment_code(i: int) -> str | None:
    """The i-th code, from 1: two digits, then three; null beyond the code space."""
    if i <= SHORT_CODES:
        return f"zc{i:02d}"
    return f"zd{i - SHORT_CODES:03d}" if i <= SHORT_CODES + LONG_CODES else None


def laid(held: int, starts: Iterable[int], n: int) -> int:
    """Characters, as bits, of those spans of length n, from the left, that touch neither each other nor what is held."""
    span, new = (1 << n) - 1, 0
    for start in starts:
        if not (held | new) >> start & span:
            new |= span << start
    return new


def offer(segment: str, code: str, freq: int, share: float) -> dict | None:
    """What a code is worth for a segment that ``freq`` texts hold, of which a ``share`` comes again: null unless it saves
    more than its line in the legend costs."""
    saving, line = token_cost(segment) - token_cost(code), token_cost(f"{code}\t{segment}\n")
    priced = {"code": code, "segment": segment, "freq": freq, "saving": saving, "legend": line, "projected": round(freq * share, 4)}
    return priced if freq * share * saving > line else None


def select(patterns: list[str], occurrences: Iterable[tuple[int, Iterable[tuple[int, int, list[int]]]]], train: int, test: int, min_freq: int = MIN_FREQ) -> list[dict]:
    """Segments that get a code, of ``patterns`` in order, longest first, each by what the earlier ones left of the texts.

    ``occurrences`` come in the same order, for each pattern by number: (text, weight, starts in order). They are read
    once, so they may be a stream. Of each text one number says which characters are held. The first code issued is the
    first of the code space, and the code that is priced is the one that is issued.
    """
    held: dict[int, int] = {}
    chosen: list[dict] = []
    share = test / train if train else 0.0
    for k, texts in occurrences:
        if (code := segment_code(len(chosen) + 1)) is None:
            break
        new = [(text, weight, bits) for text, weight, starts in texts if (bits := laid(held.get(text, 0), starts, len(patterns[k])))]
        freq = sum(weight for _, weight, _ in new)
        priced = offer(patterns[k], code, freq, share) if freq >= max(1, min_freq) else None
        if priced:
            chosen.append(priced)
            held |= {text: held.get(text, 0) | bits for text, _, bits in new}
    return chosen


def frame_codes(frames: DataFrame, text: str, order: list[str]) -> DataFrame:
    """``text`` and ``code`` of each distinct frame, numbered in the order of its first appearance."""
    firsts = frames.groupBy(F.col(text).alias("text")).agg(F.min(F.struct(*order)).alias("at")).orderBy("at", "text").limit(FRAME_CODES)
    numbered = firsts.withColumn("n", F.row_number().over(Window.orderBy("at", "text")))  # as many rows as codes at most
    return numbered.select("text", F.format_string("za%04d", "n").alias("code"))
