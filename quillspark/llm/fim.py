"""Fill-in-middle transformation: where to cut a text is found in relations of its units.

A text is a row of units, found by a pattern. Units are exploded in two steps, so that a text costs a row for each block
of units and rows for the units of the two blocks that are cut, rather than a row a unit: blocks with the running sums of
their units and lengths are joined with the cuts by ordinal, the units of the blocks that are hit get running sums of
their own, and the cuts are joined with those. The offsets of each text come together in one row, and substrings follow.

Each distinct text of an id is sent once, and all of these steps use its place: the rest of the relations are made where
it lies. Keys depend on ids and texts only, so any task can be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._shared import text_or_empty

#: Every code point.
CODE_POINTS = "."
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of 100 texts, about so many are rearranged; of 100 of these, so many with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Units of a block: has an effect on the number of rows only.
BLOCK = 64
_KEY = ["text_key", "id_key"]


def _blocks(units: str) -> str:
    """Pattern of up to ``BLOCK`` units. What no unit covers is a unit of one code point each."""
    return f"(?s)(?:{units}|.){{1,{BLOCK}}}"


def _units(units: str) -> str:
    return f"(?s)(?:{units}|.)"


def _number(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def _choices(id_key: Column, text: Column, n: Column, seed: str, rate: int, suffix_first: int) -> dict[str, Column]:
    """``form`` of each text, and after how many units its prefix (``low``) and its middle (``high``) end."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_key), 256)
    a, b = _number(digest, 0) % (n + 1), _number(digest, 1) % (n + 1)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (n == 0) | marked | (_number(digest, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_number(digest, 3) % 100 < suffix_first, "spm").otherwise("psm")
    return {"form": form, "low": F.least(a, b), "high": F.greatest(a, b)}


def _runs(name: str, order: str, *keys: str) -> Column:
    """Sum of a column over the rows so far, this one included."""
    return F.sum(name).over(Window.partitionBy(*_KEY, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def offsets(texts: DataFrame, cuts: DataFrame, units: str = CODE_POINTS) -> DataFrame:
    """Where each text is cut: ``text_key, id_key, offsets`` (map of ``cut`` to code points before it).

    ``texts`` has a row a key (``text``), ``cuts`` any number of them (``cut, ordinal``): cut number ``cut`` lies after so many
    units of the text, at least one and at most all.
    """
    blocks = texts.select(*_KEY, F.posexplode(F.regexp_extract_all("text", F.lit(_blocks(units)), F.lit(0))).alias("block", "part"))
    # a block has BLOCK units but for a text's last, whose ordinals end with the text
    blocks = blocks.withColumn("chars", F.length("part")).withColumn("to_char", _runs("chars", "block"))
    blocks = blocks.select(*_KEY, "part", (F.col("block") * BLOCK).alias("from_unit"), (F.col("to_char") - F.col("chars")).alias("from_char"))
    within = (F.col("c.ordinal") > F.col("b.from_unit")) & (F.col("c.ordinal") <= F.col("b.from_unit") + BLOCK)
    same = (F.col("c.text_key") == F.col("b.text_key")) & (F.col("c.id_key") == F.col("b.id_key"))
    hit = blocks.alias("b").join(cuts.alias("c"), same & within).select("b.*", "c.cut", "c.ordinal")
    pieces = hit.select(*_KEY, "cut", "ordinal", "from_unit", "from_char", F.posexplode(F.regexp_extract_all("part", F.lit(_units(units)), F.lit(0))).alias("place", "unit"))
    pieces = pieces.withColumn("chars", F.length("unit")).withColumn("to_char", F.col("from_char") + _runs("chars", "place", "cut"))
    found = pieces.where(F.col("from_unit") + F.col("place") + 1 == F.col("ordinal"))
    return found.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("cut", "to_char"))).alias("offsets"))  # an entry a cut


def _joined(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text, from what was made of it. Marks are found from the left: a text that holds one is never rearranged."""
    rest = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    first = F.when(form == "psm", F.substring_index(rest, SUFFIX, 1)).otherwise(F.substring_index(rest, PREFIX, 1))
    rest = F.substring(rest, F.length(first) + len(SUFFIX) + 1, F.length(output))
    then = F.substring_index(rest, MIDDLE, 1)
    middle = F.substring(rest, F.length(then) + len(MIDDLE) + 1, F.length(output))
    return F.when(form == "psm", F.concat(first, middle, then)).when(form == "spm", F.concat(then, middle, first)).otherwise(output)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = CODE_POINTS, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, digests: bool = False) -> DataFrame:
    """Per row of ``docs``: ``id_col, n`` (units), ``form`` (plain, psm, spm), ``prefix_chars, middle_chars`` (null if plain),
    ``output``; with ``digests``, ``output_sha256`` and ``restored_sha256`` in its place.

    ``units`` is a regular expression; what it doesn't cover counts by code points. A null text is an empty one; empty
    texts and those that hold a mark stay plain. Rows without an id draw by an empty one. Repeated rows get the same
    result each, worked out once. Other columns are left alone, an empty table gives none.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id_key"), text.alias("text"))
    n = F.length("text") if units == CODE_POINTS else F.size(F.regexp_extract_all("text", F.lit(_units(units)), F.lit(0)))
    chosen = rows.withColumn("n", n.cast("bigint")).withColumns(_choices(F.col("id_key"), F.col("text"), F.col("n"), seed, rate, suffix_first)).drop("text")
    cuts = chosen.where("form != 'plain'").groupBy(*_KEY).agg(F.first(F.array("low", "high")).alias("ends"))
    cuts = cuts.select(*_KEY, F.posexplode("ends").alias("cut", "ordinal")).where("ordinal > 0")
    texts = rows.groupBy(*_KEY).agg(F.first("text").alias("text"))
    whole = texts.join(offsets(texts, cuts, units), _KEY, "left")
    a, b = F.coalesce(F.col("offsets")[0], F.lit(0)).cast("int"), F.coalesce(F.col("offsets")[1], F.lit(0)).cast("int")
    whole = whole.withColumns({"a": a, "b": b, "n": n.cast("bigint")})
    whole = whole.withColumn("form", _choices(F.col("id_key"), F.col("text"), F.col("n"), seed, rate, suffix_first)["form"])
    parts = [F.substring("text", F.lit(1), F.col("a")), F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")), F.substring("text", F.col("b") + 1, F.length("text"))]
    whole = whole.withColumn("output", _joined(F.col("form"), *parts, F.col("text")))
    shown = ["output"]
    if digests:
        shown = ["output_sha256", "restored_sha256"]
        whole = whole.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)})
    whole = whole.select(*_KEY, *[F.when(F.col("form") != "plain", x.cast("bigint")).alias(c) for c, x in (("prefix_chars", F.col("a")), ("middle_chars", F.col("b") - F.col("a")))], *shown)
    return chosen.select("id", *_KEY, "n", "form").join(whole, _KEY).select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", *shown)


FIM_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
h as (select *, ('0x' || substr(x, 1, 8))::bigint % (n + 1) as a, ('0x' || substr(x, 9, 8))::bigint % (n + 1) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(x, 17, 8))::bigint % 100 >= 90 then 'plain'
      when ('0x' || substr(x, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (select doc_id, n, form, t, least(a, b) as p, greatest(a, b) - least(a, b) as m,
    substr(t, 1, least(a, b)) as pre, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) as mid, substr(t, greatest(a, b) + 1) as suf from h)
select doc_id, n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then m end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
