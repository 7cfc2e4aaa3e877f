"""Mixing sources to target weights: hash-random keys, range sort, distributed prefix sums, exact cuts, epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._shared import fresh, own_columns, sized_join, text_or_empty, written

WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST_EPOCHS = 3
SEED = "mix-1"
#: Documents in a range of keys, about; ranges of one source are sorted in separate tasks.
RANGE_ROWS = 2000
#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space."""
    return F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), BLANKS, "")).cast("bigint")


def _key(doc_id: Column, text: Column, seed: str) -> Column:
    """60 random bits of an id, or of the text where there is none."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text))))), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``, ``docs``).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at
    ``most`` times its source's size, and the excess goes to the others by weight until none is above: all others get
    one rate times their weight. The rate rises with each step, so the steps are few; each sends two sums to the driver.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    nth = (F.row_number().over(order) - 1) % len(weights)
    sizes = written(sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth + 1)), "weights")
    cap = F.col("source_size") * most
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    rate = -1.0
    while True:
        capped = F.lit(rate) * F.col("weight") >= cap
        held, free = sizes.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        after = (total - (held or 0)) / free if free else rate
        if after <= rate:
            break
        rate = after
    target = F.least(F.lit(max(rate, 0.0)) * F.col("weight"), cap.cast("double"))
    return sizes.withColumn("target", target)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"),
        _key(F.col(id_col), text_or_empty(text_col), seed).alias("key"), F.md5(text_or_empty(text_col)).alias("tie"),
    )


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], seed: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Each document with the words of its source that come before it, and the sources with epochs and rest."""
    sized = written(_sized(docs, id_col, text_col, source_col, seed), "sized")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, most)
    budget = F.floor(F.col("target") + 0.5)
    sources = sources.withColumn("epochs", F.coalesce(F.expr("cast(floor(target + 0.5d) as bigint) div nullif(source_size, 0)"), F.lit(0)).cast("bigint"))
    sources = sources.withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumn("no_source", F.col("source").isNull()).withColumn("s", F.coalesce("source", F.lit("")))
    sources = written(sources.drop("source"), "sources")
    sized = sized.withColumn("no_source", F.col("source").isNull()).withColumn("s", F.coalesce("source", F.lit("")))
    placed = sized_join(sized, sources, ["s", "no_source"], "inner")
    ranges = F.ceil(F.col("docs") / RANGE_ROWS)
    placed = placed.withColumn("range", F.shiftright(F.shiftright("key", 28) * ranges, 32))
    sums = placed.groupBy("s", "no_source", "range").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("s", "no_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("offset", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n"), "offsets")
    placed = sized_join(placed, sums, ["s", "no_source", "range"], "inner")
    inside = Window.partitionBy("s", "no_source", "range").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))), sources


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, most: int = MOST_EPOCHS) -> DataFrame:
    """How many words the mix takes of each document: ``id_col``, ``size``, ``source_size``, ``target``, ``taken``.

    The size of a document is its number of words, 0 for null. Each source takes exactly its target, rounded to a
    word: whole epochs over all its documents, then documents in the order of a hash of their id until the rest is
    used up; the last one may be taken in part. Keys depend on ids (on texts where there is none) and the seed only, so reruns agree; ties go by
    id, size and a digest of the text, so equal rows alone can change places. A null source is a source like any other,
    after the others. Repeated and null ids keep their own rows. Only ids, sizes and keys are shuffled, never texts.
    """
    placed, _ = _placed(docs, id_col, text_col, source_col, weights, seed, most)
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, most: int = MOST_EPOCHS) -> DataFrame:
    """The rows of the mix: each document once per epoch that takes it, whole, with the columns of ``docs``.

    The document at a source's cut is taken if at least half of its words still fit, so a source misses its target by
    half a document at most. Documents without words take nothing from a budget: they stay once where they sort
    before the cut, or in each whole epoch. The cut of each source is applied to the documents where they lie: a
    row per source is joined to them, and no text is shuffled unless there are too many sources to broadcast.
    """
    placed, sources = _placed(docs, id_col, text_col, source_col, weights, seed, most)
    fits = (F.col("before") < F.col("rest")) & (2 * (F.col("rest") - F.col("before")) >= F.col("size"))
    last = placed.where(fits).groupBy("s", "no_source").agg(F.max(F.struct("key", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "size", "tie")).alias("cut"))
    cuts = written(sources.join(last, ["s", "no_source"], "left").select("s", "no_source", "epochs", "cut"), "cuts")
    s, none, key, size, tie, cut, epochs, copies = fresh(docs, "s", "no_source", "key", "size", "tie", "cut", "epochs", "copies")
    cuts = cuts.toDF(s, none, epochs, cut)
    rows = docs.withColumns({s: F.coalesce(source_col, F.lit("")), none: F.col(source_col).isNull(), key: _key(F.col(id_col), text_or_empty(text_col), seed), size: word_count(text_or_empty(text_col)), tie: F.md5(text_or_empty(text_col))})
    rows = sized_join(rows, cuts, [s, none], "inner")
    own = F.struct(F.col(key).alias("key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(size).alias("size"), F.col(tie).alias("tie"))
    within = F.coalesce(own <= F.col(cut), F.lit(False)).cast("int")
    rows = rows.withColumn(copies, F.col(epochs).cast("int") + within)
    return rows.withColumn(copies, F.explode(F.expr(f"array_repeat(0, `{copies}`)"))).select(*own_columns(docs))


MIX_SQL = r"""
with d as (
  select doc_id, source,
    length(translate(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as size,
    cast('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, '')))), 1, 15) as bigint) as k, md5(coalesce(text, '')) as tie
  from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s as (select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from s0),
r as (select *, 3 * source_size as cap, row_number() over (order by 3.0::double * source_size / w, source nulls last) as n from s),
a as (select *, sum(source_size) over ()::bigint as total,
    coalesce(sum(cap) over (order by n rows between unbounded preceding and 1 preceding), 0)::bigint as held,
    sum(w) over (order by n rows between current row and unbounded following)::bigint as open_w from r),
l as (select arg_min((total - held)::double / open_w, n) filter (where (total - held)::double / open_w * w < cap) as rate from a),
t as (select source, source_size, least(coalesce(rate, 0) * w, cap::double) as target from a, l),
b as (select *, floor(target + 0.5)::bigint as budget from t),
e as (select *, coalesce(budget // nullif(source_size, 0), 0) as epochs from b),
p as (select doc_id, size, e.source_size, target, epochs, budget - epochs * e.source_size as rest,
    coalesce(sum(size) over (partition by d.source order by k, doc_id, size, tie rows between unbounded preceding and 1 preceding), 0) as before_
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before_)))::bigint as taken from p
"""
