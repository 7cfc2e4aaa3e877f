"""I-Match fingerprints over an IDF band of the lexicon, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.stats import place_in
from quillspark.llm._shared import sized_join, text_or_empty, written

#: Shares of all documents that a term of the lexicon stands in: idf between ln 64 and ln 512. There are at most
#: (mean number of distinct terms in a document) / RARE such terms, however many documents there are.
RARE, FREQUENT = 1 / 512, 1 / 64
#: Randomised sub-lexicons: (share of the lexicon's terms that each keeps, how many). They keep few terms, as an edit
#: spares only those that hold none of the terms it touches; the several shares suit short and long texts.
SUBSETS = ((1 / 8, 4), (1 / 16, 8), (1 / 32, 10), (1 / 64, 12), (1 / 128, 8), (1 / 256, 6))
RATES = tuple(rate for rate, n in SUBSETS for _ in range(n))
#: Documents in a range of ids, about, and most ranges.
RANGE_ROWS, MOST_RANGES = 4000, 20_000
_END = 0  # stands for a document in the lexicon, so that one without any of its terms isn't lost


def terms(text: Column) -> Column:
    """Distinct terms: lower-cased runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def term_hash(term: Column) -> Column:
    return F.xxhash64(term)


def lexicon(docs: DataFrame, text_col: str = "text", rare: float = RARE, frequent: float = FREQUENT, rates: tuple[float, ...] = RATES) -> DataFrame:
    """``h`` (hash of a term in the band) and ``sub`` (a sub-lexicon that keeps the term), a row for each of both.

    Document frequencies are counted over all documents. A term in fewer than two documents is never kept.
    """
    n = docs.count()
    df = docs.select(F.explode(F.transform(terms(F.col(text_col)), term_hash)).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= max(2, math.ceil(n * rare))) & (F.col("df") <= max(2, math.floor(n * frequent))) & (F.col("h") != _END))
    keep = [F.when(F.pmod(F.xxhash64("h", F.lit(i + 1)), F.lit(1 << 30)) < int(rate * (1 << 30)), F.lit(i)) for i, rate in enumerate(rates)]
    kept = band.select("h", F.explode(F.array_compact(F.array(*keep))).alias("sub"))
    return written(kept.union(docs.sparkSession.sql(f"select bigint({_END}), -1")), "lexicon")


def _subset_hashes(found: Column, n: int) -> Column:
    """32 bits for each sub-lexicon: the hash of the sorted terms that it keeps, null if it keeps none.

    ``found`` has pairs (sub-lexicon, term), sorted; one fold goes over them and fills the places of sub-lexicons in turn.
    """
    nulls = lambda k: F.array_repeat(F.lit(None).cast("bigint"), k)
    start = F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("bigint").alias("run"), nulls(F.lit(0)).alias("done"))

    def closed(acc: Column, upto: Column) -> Column:
        """Hashes of all sub-lexicons before ``upto``."""
        ended = F.concat(acc["done"], F.array(acc["run"].bitwiseAND(0xFFFFFFFF)), nulls(upto - acc["sub"] - 1))
        return F.when(acc["sub"] < 0, nulls(upto)).otherwise(ended)

    def step(acc: Column, x: Column) -> Column:
        same = acc["sub"] == x["sub"]
        run = F.xxhash64(F.when(same, acc["run"]).otherwise(F.lit(0).cast("bigint")), x["h"])
        return F.struct(x["sub"].alias("sub"), run.alias("run"), F.when(same, acc["done"]).otherwise(closed(acc, x["sub"])).alias("done"))

    return F.aggregate(found, start, step, lambda acc: closed(acc, F.lit(n)))


def shown(hashes: Column, plain: Column) -> Column:
    """A fingerprint as a string: eight hex digits or a minus for each sub-lexicon; of a text without any term of the
    lexicon, a hash of the text."""
    parts = F.array_join(F.transform(hashes, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 8, "0")), F.lit("-"))), "")
    return F.when(F.exists(hashes, lambda x: x.isNotNull()), parts).otherwise(F.concat(F.lit("~"), F.lower(F.lpad(F.hex(plain), 16, "0"))))


def likeness(a: Column, b: Column, same_text: Column) -> Column:
    """Of the sub-lexicons that keep a term of either text, the share with equal hashes; without any, whether the texts are equal."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(either > 0, equal / either).otherwise(same_text.cast("double"))


def _hashed(rows: DataFrame, key: list[str], texts: list[str], payload: list[str], words: DataFrame, n: int) -> DataFrame:
    """``key``, ``payload`` and, for each of ``texts``, ``<text>_hashes`` and ``<text>_plain``.

    If ``rows`` are dealt out by a part of ``key``, nothing is shuffled: the lexicon, whose size is bounded by the number of
    distinct terms of a document, is broadcast, unless texts are so long that it is too large for that.
    """
    own = F.struct(*payload, *[F.xxhash64(F.lower(F.col(t))).alias(f"{t}_plain") for t in texts])
    none = F.lit(None).cast(rows.select(own.alias("x")).schema["x"].dataType)

    def tagged(t: str, i: int) -> Column:
        return F.transform(terms(F.col(t)), lambda x: F.struct(term_hash(x).alias("h"), F.lit(i).alias("of"), none.alias("own")))

    each = [tagged(t, i) for i, t in enumerate(texts)]
    end = F.array(F.struct(F.lit(_END).cast("bigint").alias("h"), F.lit(-1).alias("of"), own.alias("own")))
    found = rows.select(*key, F.explode(F.concat(*each, end)).alias("t")).select(*key, "t.*")
    found = sized_join(found, words, ["h"], "inner")
    lists = [F.array_sort(F.collect_list(F.when(F.col("of") == i, F.struct("sub", "h")))).alias(f"{t}_terms") for i, t in enumerate(texts)]
    found = found.groupBy(*key).agg(F.any_value("own", True).alias("own"), *lists)
    return found.select(*key, "own.*", *[_subset_hashes(F.col(f"{t}_terms"), n).alias(f"{t}_hashes") for t in texts])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: DataFrame | None = None, rates: tuple[float, ...] = RATES) -> DataFrame:
    """``id_col`` and ``fingerprint`` of each row's whole text, over the lexicon ``words`` (of ``docs`` itself if not given).

    Null texts count as empty. Rows with one id and different texts keep their own fingerprints; equal rows give one.
    """
    words = lexicon(docs, text_col, rates=rates) if words is None else words
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    out = _hashed(rows.dropDuplicates(["id", "tie"]), ["id", "tie"], ["text"], [], words, len(rates))
    return out.select(F.col("id").alias(id_col), shown(F.col("text_hashes"), F.col("text_plain")).alias("fingerprint"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: tuple[float, ...] = RATES) -> DataFrame:
    """Fingerprint every whole text and an edited text: its last third replaced by the beginning of the next document.

    The next document is the one with the next smaller id, after the last the first; null ids come last, and rows with
    equal ids follow one another by a hash of their text. Of n code points, the last floor(n / 3) give way to as many
    of the next text, or all it has. A null text is empty. Returns ``id_col``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` (likeness to the edited text) and ``near_next`` (to the next
    document). A single document is its own next one; an empty table gives no rows. Ids have to be numbers.

    Documents are dealt out once, by ranges of ids; what follows a document in its range is read by a window, and the
    first document of each range, which follows the last one of the range before, is joined by the range's number.
    """
    words = lexicon(docs, text_col, rates=rates)
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    n, n_known = base.agg(F.count("*"), F.count("id")).first()
    ranges = max(1, min(MOST_RANGES, math.ceil(n_known / RANGE_ROWS)))
    bounds = base.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * max(1000, ranges))).first()[0] if ranges > 1 else None
    bounds = sorted(set(bounds or []))
    base = base.withColumn("tie", F.xxhash64("text"))
    below = len(bounds) - place_in(F.col("id"), bounds)  # the largest ids are in range 0
    # rows without an id come after the others, by the hash of their text, in ranges of their own
    null_ranges = max(1, min(MOST_RANGES, math.ceil((n - n_known) / RANGE_ROWS)))
    by_tie = F.greatest(F.lit(0), F.least(F.lit(null_ranges - 1), F.floor((0.5 - F.col("tie") / float(1 << 64)) * null_ranges)))
    base = base.withColumn("pid", F.coalesce(below, len(bounds) + 1 + by_tie).cast("int"))
    firsts = written(base.groupBy("pid").agg(F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")).alias("x")).select("pid", "x.id", "x.tie"), "firsts")
    order = Window.orderBy("pid")  # a row per range
    ring = firsts.withColumn("before", F.coalesce(F.lag("pid").over(order), F.lit(None))).withColumn("last", F.max("pid").over(Window.partitionBy(F.lit(1))))
    ring = written(ring.select(F.coalesce("before", "last").alias("before"), "pid", "id", "tie"), "ring")
    heads = base.select(F.col("pid").alias("p"), F.col("id").alias("i"), F.col("tie").alias("t"), "text").join(F.broadcast(ring), (F.col("p") == F.col("pid")) & F.col("i").eqNullSafe(F.col("id")) & (F.col("t") == F.col("tie")))
    heads = written(heads.select("before", "pid", "text").dropDuplicates(["pid"]), "heads")
    head_prints = written(_hashed(heads.select(F.col("before").alias("pid"), "text"), ["pid"], ["text"], [], words, len(rates)).toDF("pid", "head_plain", "head_hashes"), "heads")

    inside = Window.partitionBy("pid").orderBy(F.col("id").desc_nulls_last(), F.col("tie").desc())
    rows = base.withColumn("rn", F.row_number().over(inside)).withColumn("follows", F.lead("text").over(inside))
    rows = rows.join(heads.select(F.col("before").alias("pid"), F.col("text").alias("head")), "pid", "left")
    chars, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.coalesce("follows", "head"), F.lit(1), cut))
    rows = rows.select("pid", "rn", "id", "text", chars.cast("bigint").alias("n_chars"), edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    found = _hashed(rows, ["pid", "rn"], ["text", "edited"], ["id", "n_chars", "edited_sha256"], words, len(rates))
    along = Window.partitionBy("pid").orderBy("rn")
    found = found.withColumn("next_hashes", F.lead("text_hashes").over(along)).withColumn("next_plain", F.lead("text_plain").over(along))
    found = found.join(head_prints, "pid", "left")
    ends = F.col("next_plain").isNull()
    next_hashes, next_plain = F.when(ends, F.col("head_hashes")).otherwise(F.col("next_hashes")), F.coalesce("next_plain", "head_plain")
    return found.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        shown(F.col("text_hashes"), F.col("text_plain")).alias("fingerprint"), shown(F.col("edited_hashes"), F.col("edited_plain")).alias("edited_fingerprint"),
        likeness(F.col("text_hashes"), F.col("edited_hashes"), F.col("text_plain") == F.col("edited_plain")).alias("near_edited"),
        likeness(F.col("text_hashes"), next_hashes, F.col("text_plain") == next_plain).alias("near_next"),
    )
