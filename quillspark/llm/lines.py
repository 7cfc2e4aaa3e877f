"""Cross-site line deduplication by distinct-site spread, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import fresh, own_columns, sized_join, written

#: A line on so many distinct sites is boilerplate.
SITES = 5
#: Estimates within this share of the threshold (or one site) are counted exactly; sketches of 2^12 registers have a
#: standard error of 1.6 %.
MARGIN, LG_K = 0.15, 12
#: Up to so many boilerplate lines, each document looks its lines up where it lies, in a set that goes with the plan; of
#: more, the documents are joined with the lines that each has to drop. The result is the same.
KNOWN = 20_000


def _split(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _hashes(line: Column) -> Column:
    """128 bits, so that no two lines of a large corpus are taken for one another."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2"))


def boilerplate(hashed: DataFrame, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """Hashes of the lines on at least ``sites`` distinct sites, of rows (``id``, ``site``, ``h1``, ``h2``).

    A HyperLogLog sketch of the sites of each line merges by aggregation, partial sketches first, so a line that
    stands in every document costs no task more than its share. Lines whose estimate lies near the threshold get an
    exact distinct count, which also aggregates in two steps. Also gives ``first``: the smallest id with the line.
    A null site counts as one site of its own.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col("site").cast("string")), F.lit("n"))
    spread = hashed.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg(site, LG_K)).alias("seen"), F.min("id").alias("first"))
    low, high = sites - max(1, margin * sites), sites + max(1, margin * sites)
    spread = written(spread.where(F.col("seen") >= low), "spread")
    near = spread.where(F.col("seen") <= high).select("h1", "h2")
    exact = sized_join(hashed, near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct(site).alias("n")).where(F.col("n") >= sites)
    sure = spread.where(F.col("seen") > high).select("h1", "h2", "first")
    return sure.unionByName(spread.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, counts: bool = False) -> DataFrame:
    """``docs`` without the lines that stand on ``sites`` distinct sites or more, except in the document of smallest id.

    Lines are separated by a newline and compared without spaces around them; blank lines are left alone, as are
    repeats within a document that keeps the line. One document keeps each line, so nothing is lost from the corpus
    and a text that is copied across sites survives once. Every row stays, with an empty text if all its lines go; a
    null text stays null, and a text that loses nothing stays as it is. Rows that repeat an id count as one document;
    null ids count as one document too, which comes after the others. Other columns pass through. With ``counts``,
    ``n_lines`` and ``n_removed`` follow.
    """
    wanted = F.array_distinct(F.transform(_split(text_col), lambda x: F.trim(x)))
    part = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(0)  # rows without an id are told apart by their texts
    lines = docs.select(F.col(id_col).alias("id"), part.alias("part"), F.col(site_col).alias("site"), F.explode(wanted).alias("line")).where("line <> ''")
    hashed = written(lines.select("id", "part", "site", _hashes(F.col("line")).alias("h")).select("id", "part", "site", "h.h1", "h.h2"), "lines")
    common = written(boilerplate(hashed, sites), "boilerplate")
    gone, key, own, lines_, kept = fresh(docs, "gone", "key", "part", "lines", "kept")
    common = common.where(F.col("first").isNotNull())
    known = [tuple(r) for r in common.select("h1", "h2").limit(KNOWN + 1).collect()]
    if len(known) <= KNOWN:
        firsts = common.groupBy(F.col("first").alias(key)).agg(F.collect_list(F.struct("h1", "h2")).alias(gone))
        out = docs.join(F.broadcast(firsts), docs[id_col] == F.col(key), "left").withColumn(lines_, _split(text_col))
        listed = [", ".join(f"{r[k]}L" for r in known) or "null" for k in (0, 1)]
        hashes = ["xxhash64(trim(x))", "xxhash64(trim(x), 1)"]
        here = f"coalesce(array_contains(`{gone}`, named_struct('h1', {hashes[0]}, 'h2', {hashes[1]})), false)"
        out = out.withColumn(kept, F.expr(f"filter(`{lines_}`, x -> trim(x) = '' or not coalesce({hashes[0]} in ({listed[0]}) and {hashes[1]} in ({listed[1]}), false) or {here})"))
    else:
        hits = sized_join(hashed, common, ["h1", "h2"], "inner").where(~F.col("id").eqNullSafe(F.col("first")))
        drops = hits.groupBy(F.col("id").alias(key), F.col("part").alias(own)).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
        out = docs.join(drops, docs[id_col].eqNullSafe(drops[key]) & (part == drops[own]), "left")
        out = out.withColumn(lines_, F.when(F.col(gone).isNotNull(), _split(text_col)))
        out = out.withColumn(kept, F.filter(lines_, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(gone), _hashes(F.trim(x)))))
    text = F.when(F.size(lines_) == F.size(kept), F.col(text_col)).otherwise(F.coalesce(F.array_join(kept, "\n"), F.col(text_col)))
    more = [F.coalesce(F.size(_split(text_col)), F.lit(0)).alias("n_lines"), F.coalesce(F.size(lines_) - F.size(kept), F.lit(0)).alias("n_removed")] if counts else []
    return out.select(*[text.alias(n) if n == text_col else c for n, c in zip(docs.columns, own_columns(docs), strict=True)], *more)


LINES_SQL = """
with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line from documents),
b as (select trim(line) as k, min(doc_id) as first from l where trim(line) <> '' group by 1 having count(distinct source) >= 5),
g as (select d.doc_id, d.text, list_filter(string_split(d.text, chr(10)), lambda x: trim(x) = '' or not list_contains(coalesce(h.ks, []), trim(x))) as kept
  from documents d left join (select l.doc_id, list(distinct b.k) as ks from l join b on trim(l.line) = b.k where l.doc_id <> b.first group by 1) h using (doc_id))
select doc_id, coalesce(len(string_split(text, chr(10))), 0)::int as n_lines, coalesce(len(string_split(text, chr(10))) - len(kept), 0)::int as n_removed,
  case when text is null then null else array_to_string(kept, chr(10)) end as text from g
"""
