"""Queries over stored ledgers: fixtures are written from the driver's tables, read by the scans, and summarised; the SQL
says the same of the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark import functions
from quillspark.functions import python, stats, text
from quillspark.operators import aggregates, codec, dedupe, joins, ordering
from quillspark.plans import experiment, regrade
from quillspark.plans.queries import _COMPACT, _COMPACT_SPARK, _REPLY, BOOK, LABELLED, ORACLES, RULES, _coded_sql, _contain, _cost, _jaccard, _lex, _mcnemar, _norm, _set, _wilson, query, read, turns, verdicts
from quillspark.sources import runs, scans, schemas, sinks
from quillspark.sources.scratch import folder, text_files, written
from quillspark.streaming import ledger as stream
from quillspark.streaming import units

# --- fixtures -----------------------------------------------------------------------------------------------------

#: The quiz of an item: three words of its text each, answered under two conditions.
_QUIZ_SQL = """(select item_id, 't' || item_id as task_id, q, 'q' || q as question, text as passage, array_to_string(string_split(text, ' ')[3 * q + 1 : 3 * q + 3], ' ') as expected,
  case when (item_id + q) % 3 <> 0 then array_to_string(string_split(text, ' ')[3 * q + 1 : 3 * q + 3], ' ') else 'no idea' end as plain,
  case when (item_id + q) % 2 = 0 then array_to_string(string_split(text, ' ')[3 * q + 1 : 3 * q + 3], ' ') || ' indeed' else 'none of it' end as short,
  ['prose', 'fact', 'formulaic'][(item_id % 3)::int + 1] as register from benchmark, range(4) r(q))"""
_GRADED = f"""(select *, {_contain(_set(_norm('expected')), _set(_norm('passage')))} >= 0.8 as anchored, {_contain(_set(_norm('plain')), _set(_norm('expected')))} >= 0.8 as plain_match,
  {_contain(_set(_norm('short')), _set(_norm('expected')))} >= 0.8 as short_match from {_QUIZ_SQL})"""


def _register(item: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("prose", "fact", "formulaic"))), (item % 3).cast("int") + 1)


def quiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
    expected = F.array_join(F.slice(F.split("text", " "), 3 * F.col("q") + 1, F.lit(3)), " ")
    place = F.col("item_id") + F.col("q")
    return rows.select(
        "item_id", F.concat(F.lit("t"), "item_id").alias("task_id"), F.col("q").alias("q_index"), F.concat(F.lit("q"), "q").alias("question"), F.col("text").alias("passage"), expected.alias("expected"),
        F.when(place % 3 != 0, expected).otherwise("no idea").alias("plain"), F.when(place % 2 == 0, F.concat(expected, F.lit(" indeed"))).otherwise("none of it").alias("short"),
        _register(F.col("item_id")).alias("register"), F.lit("r1").alias("run_id"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as JSON lines (``value``)."""
    rows = quiz(spark, sf_dir)
    sides = F.explode(F.create_map(F.lit("A-FROM-PLAIN"), "plain", F.lit("A-FROM-COMPRESSED"), "short")).alias("condition", "raw_answer")
    answers = rows.select(F.lit("cond_answer").alias("type"), "task_id", "q_index", "question", "expected", "run_id", F.lit(False).alias("correct"), sides)
    base = rows.select(F.lit("quiz_answer").alias("type"), "task_id", "q_index", "question", "expected", "run_id", "register", (F.col("plain") == F.col("expected")).alias("correct"), F.col("plain").alias("raw_answer"))
    items = rows.select(F.lit("quiz_item").alias("type"), "task_id", "q_index", "question", F.col("expected").alias("answer"), "run_id")
    judged = rows.where("plain <> expected or q_index = 0").select(
        F.lit("judge").alias("type"), "task_id", "q_index", "run_id", (F.col("plain") == F.col("expected")).alias("sampled_hit"), F.when(F.col("q_index") == 1, "grader_wrong").when(F.col("q_index") == 2, "unparsed").otherwise("wrong").alias("verdict")
    )
    n = text.approx_count("text")
    attempts = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(k).alias("attempt"), v.alias("approx_tokens")) for c, k, v in (("R-PLAIN", 1, n), ("R-CABLESE", 1, n), ("R-CABLESE", 2, F.ceil(n / 2)))])).alias("a")
    texts = read(spark, sf_dir, "benchmark").select(F.lit("record").alias("type"), F.concat(F.lit("t"), "item_id").alias("task_id"), F.lit("r1").alias("run_id"), "text", attempts).select("type", "task_id", "run_id", "text", "a.*")
    parts = [df.select(sinks.canonical_json(df).alias("value")) for df in (answers, base, items, judged, texts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SLICES = ["slice_0001.jsonl", "slice_0002.jsonl", "slice_0003.jsonl"]


def stored(spark: SparkSession, sf_dir: str, names: list[str] | None = None, copies: int = 1) -> str:
    """A folder of ledger files; with copies, each line stands in as many of them."""
    names, path = names or _SLICES, folder(spark, "ledger")
    lines = records(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return text_files(lines.select(F.pmod(F.xxhash64("value") + F.col("k"), F.lit(len(names))).cast("int").alias("file"), "value"), path, names)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read from files that repeat each line."""
    return scans.ledger(spark, stored(spark, sf_dir, copies=2))


def tasks(spark: SparkSession, sf_dir: str, name: str = "t{}.json") -> str:
    """A folder of task files, and a README that is none."""
    rows = read(spark, sf_dir, "benchmark")
    task = F.struct(
        F.concat(F.lit("t"), "item_id").alias("id"), _register(F.col("item_id")).alias("register"), F.lit("short").alias("len_class"), F.col("text").alias("passage"), F.lit("q").alias("question"),
        F.lit("a").alias("expected_answer"), F.array(F.lit("x")).alias("facts"),
    )
    items = ordering.ranked(rows, "item_id", [], "file")
    n = rows.count()
    lines = items.select("file", F.to_json(task).alias("value")).unionByName(spark.createDataFrame([(n, "{}")], "file bigint, value string"))
    return text_files(lines, folder(spark, "tasks"), [*(name.format(f"{i:04d}") for i in range(n)), "README.json"])


# --- scans --------------------------------------------------------------------------------------------------------


@query("select 't' || item_id as id, ['prose', 'fact', 'formulaic'][(item_id % 3)::int + 1] as register, md5(text) as digest from benchmark where item_id % 3 <> 2")
def stored_task_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.task_bank(spark, tasks(spark, sf_dir), drop_register="formulaic").select("id", "register", F.md5("passage").alias("digest"))


@query("select 't' || item_id as id, md5(text) as digest from benchmark")
def stored_numbered_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.numbered_tasks(spark, tasks(spark, sf_dir, "task_{}.json")).select("id", F.md5("passage").alias("digest"))


_TYPES = f"""(select 'cond_answer' as type, 2 * count(*) as n from {_QUIZ_SQL} union all select 'quiz_answer', count(*) from {_QUIZ_SQL} union all select 'quiz_item', count(*) from {_QUIZ_SQL}
  union all select 'judge', count(*) from {_QUIZ_SQL} where plain <> expected or q = 0 union all select 'record', 3 * count(*) from benchmark)"""


@query(f"select type, n::bigint as n from {_TYPES}")
def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files repeat lines; each counts once."""
    return ledger(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query(f"select type, n::bigint as n from {_TYPES}")
def stored_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial and stub files beside the slices aren't read."""
    path = stored(spark, sf_dir)
    text_files(spark.createDataFrame([(0, "broken"), (1, '{"type": "stub"}')], "file int, value string"), f"{path}/more", ["slice_0009.jsonl.partial-7", "stub.jsonl"])
    return scans.slices(spark, f"{path}/{{*.jsonl,more}}").groupBy("type").agg(F.count("*").alias("n"))


@query(f"select type, n::bigint as n from {_TYPES}")
def stored_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second merge of the same shards changes nothing."""
    path = stored(spark, sf_dir)
    return scans.shards(spark, path, scans.shards(spark, path)).groupBy("type").agg(F.count("*").alias("n"))


@query(f"select type, n::bigint as n from {_TYPES}")
def stored_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged as sorted canonical lines, twice."""
    once = experiment.merge(ledger(spark, sf_dir), folder(spark, "merged"))
    return experiment.merge(once.unionByName(ledger(spark, sf_dir)), folder(spark, "merged")).groupBy("type").agg(F.count("*").alias("n"))


@query(f"select type, n::bigint as n from {_TYPES} where type in ('judge', 'record')")
def stored_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two goes, a folder for each type; views of two types."""
    path, rows = folder(spark, "appended"), ledger(spark, sf_dir)
    sinks.append_ledger(rows.where("q_index is null"), path)
    sinks.append_ledger(rows.where("q_index is not null"), path)
    back = spark.read.parquet(path)
    sizes = [scans.view(back, kind).agg(F.lit(kind).alias("type"), F.count("*").alias("n")) for kind in ("judge", "record")]
    return sizes[0].unionByName(sizes[1])


@query(f"select task_id, q as q_index, md5(expected) as digest, (select {_cost('text')} from benchmark b where b.item_id = z.item_id) as plain_tokens from {_QUIZ_SQL} z where q < 2")
def stored_guarded_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two items of each task, with both of its records; an error if any lacks one."""
    rows = scans.guarded_source(ledger(spark, sf_dir), scans.task_bank(spark, tasks(spark, sf_dir)), quota=2)
    return rows.select("task_id", "q_index", F.md5("answer").alias("digest"), text.approx_count("plain").alias("plain_tokens"))


@query(f"select 't' || item_id as task_id, c as condition, case c when 'R-PLAIN' then n else ceil(n / 2.0)::bigint end as approx_tokens from (select item_id, {_cost('text')} as n from benchmark), (select unnest(['R-PLAIN', 'R-CABLESE']) as c)")
def stored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.source_tokens(ledger(spark, sf_dir))


@query(f"select task_id, condition, q as q_index, question, anchored and case condition when 'A-FROM-PLAIN' then plain_match else short_match end as correct from {_GRADED}, (select unnest(['A-FROM-PLAIN', 'A-FROM-COMPRESSED']) as condition)")
def stored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a source run that has no regraded rows: graded again, by the passages of the bank."""
    bank = scans.task_bank(spark, tasks(spark, sf_dir))
    rows = ledger(spark, sf_dir)
    return scans.source_verdicts(rows, None, scans.passages(bank, wanted=scans.view(rows, "cond_answer")))


@query("select count(*) filter (where item_id % 2 = 0) as overridden, count(*) as n, sum(length(case when item_id % 2 = 0 then 'own' else text end))::bigint as chars from benchmark")
def stored_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of every other passage win over the bank."""
    path = folder(spark, "overrides")
    pairs = read(spark, sf_dir, "benchmark").where("item_id % 2 = 0").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("t"), "item_id"), F.lit("own")))).alias("passages"))
    sinks.write_if_absent(pairs, path)
    sinks.write_if_absent(pairs.limit(0), path)  # is there already
    rows = scans.passages(scans.task_bank(spark, tasks(spark, sf_dir)), scans.artifact(spark, path, "passages map<string, string>"))
    return rows.agg(F.count_if(F.col("passage") == "own").alias("overridden"), F.count("*").alias("n"), F.sum(F.length("passage")).cast("bigint").alias("chars"))


def _tables(spark: SparkSession) -> str:
    """Two codebook files; one has a code twice and one that is the other's expansion."""
    entries = lambda pairs: F.array(*[F.struct(F.lit(c).alias("code"), F.lit(e).alias("expansion"), F.lit(True).alias("case_sensitive")) for c, e in pairs])
    book = [(e.code, e.expansion) for e in BOOK]
    rows = spark.range(2).select(F.col("id").alias("file"), F.to_json(F.when(F.col("id") == 0, F.struct(F.lit("a").alias("name"), entries([*book, ("AB", "alpha beta")]).alias("entries"))).otherwise(F.struct(F.lit("b").alias("name"), entries([("ab", "other"), ("or", "third")]).alias("entries")))).alias("value"))
    return text_files(rows, folder(spark, "codebook"), ["a.json", "b.json"])


_BOOK_ROWS = ", ".join(f"('a', '{e.code}', '{e.expansion}')" for e in BOOK)


@query(f"select \"table\", code, expansion, true as case_sensitive, row_number() over (order by -length(expansion), lower(expansion), lower(code)) - 1 as place from (values {_BOOK_ROWS}, ('a', 'AB', 'alpha beta'), ('b', 'ab', 'other'), ('b', 'or', 'third')) t(\"table\", code, expansion)")
def stored_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all tables in the one order that all use."""
    rows = scans.codebook(spark, _tables(spark)).collect()
    return spark.createDataFrame([(r.table, r.code, r.expansion, r.case_sensitive, k) for k, r in enumerate(rows)], "table string, code string, expansion string, case_sensitive boolean, place bigint")


@query("select * from (values ('duplicate code', 'a', 'AB'), ('code is an expansion', 'b', 'or')) t(fault, \"table\", code)")
def stored_codebook_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.codebook_faults(scans.codebook(spark, _tables(spark)))


@query("select 'a,an,the' as articles, 'are,is,was,were' as copulas, 'being' as verb_words, 'ed,ing' as verb_endings, 'between>btwn' as derivations")
def stored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "rules")
    value = '{"drop_articles": ["a", "an", "the"], "drop_copulas": ["are", "is", "was", "were"], "copula_next_verb_stoplist": ["being"], "copula_next_verb_suffixes": ["ed", "ing"], "derivations": [{"word": "between", "derived": "btwn"}]}'
    rules = scans.rules(spark, text_files(spark.createDataFrame([(0, value)], "file int, value string"), path, ["rules.json"]))
    lists = [",".join(x) for x in (rules.articles, rules.copulas, rules.verb_words, rules.verb_endings)]
    return spark.createDataFrame([(*lists, ",".join(f"{w}>{d}" for w, d in rules.derivations.items()))], "articles string, copulas string, verb_words string, verb_endings string, derivations string")


@query(f"select 's' || (user_id % 9) as session, count(*) as n, sum(length({_COMPACT}))::bigint as chars from events group by 1")
def stored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id") % 9).alias("session"), F.col("event_id").cast("int").alias("seq"), F.expr(_COMPACT_SPARK).alias("frame_text"))
    path = folder(spark, "frames")
    rows.write.json(path)
    return scans.frames(spark, path).groupBy("session").agg(F.count("*").alias("n"), F.sum(F.length("frame_text")).cast("bigint").alias("chars"))


@query(f"select 'b' || (row_number() over (order by item_id) - 1) || '.txt' as name, (length(text) + 1)::bigint as chars, {_cost('text')} as approx_tokens from benchmark")
def stored_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files with their sizes."""
    items = ordering.ranked(read(spark, sf_dir, "benchmark"), "item_id", [], "file")
    path = text_files(items.select("file", F.col("text").alias("value")), folder(spark, "bundle"), [f"b{i}.txt" for i in range(items.count())])
    return scans.text_bundle(spark, [path]).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("chars").cast("bigint").alias("chars"), "approx_tokens")


@query("select event_type as name, min(event_id)::bigint as first_id from events group by 1")
def stored_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool definitions in source files, each name once, the first by file and place; events stand for calls."""
    rows = ordering.ranked(read(spark, sf_dir, "events"), "event_id", [], "k").where("event_type is not null")
    lines = rows.groupBy("event_type").agg(F.min("event_id").alias("first_id")).select(F.lit(0).alias("file"), F.format_string('x = {"name": "%s", "first": %d, "args": {"a": "}"}}; y = {"other": 1}', "event_type", "first_id").alias("value"))
    path = text_files(lines.unionByName(lines.withColumn("file", F.lit(1)).withColumn("value", F.replace("value", F.lit('"first": '), F.lit('"first": 9')))), folder(spark, "tools"), ["a.js", "b.js"])
    return scans.tool_definitions(spark, path, r'\{"').select("name", F.get_json_object("definition", "$.first").cast("bigint").alias("first_id"))


# --- sinks --------------------------------------------------------------------------------------------------------


@query(f"select count(*) filter (where not anchored) as rejected, count(*) as n from {_GRADED}")
def stored_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that their passage doesn't anchor, written if there are any, and counted from the file."""
    rows = quiz(spark, sf_dir)
    kept, gone = joins.gate(rows, "passage", "expected")
    path = folder(spark, "rejects")
    back = spark.read.schema("task_id string").json(path) if sinks.rejects(gone, path) else gone
    return kept.agg(F.count("*").alias("k")).crossJoin(F.broadcast(back.agg(F.count("*").alias("rejected")))).select("rejected", (F.col("k") + F.col("rejected")).alias("n"))


@query("select sum(strlen(text) + 1)::bigint as length, true as same from benchmark")
def stored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of files before and after a scan show that it left them alone."""
    path = text_files(read(spark, sf_dir, "benchmark").select(F.lit(0).alias("file"), F.col("text").alias("value")), folder(spark, "evidence"), ["a.txt"])
    before, after = sinks.evidence(read(spark, sf_dir, "benchmark"), path), sinks.evidence(scans.ledger_lines(spark, path), path)
    both = before.join(after.select("path", F.col("sha256").alias("again")), "path")
    return both.agg(F.sum("length").cast("bigint").alias("length"), F.bool_and(F.col("sha256") == F.col("again")).alias("same"))


@query("select register, arm, count(*) as n, register = 'formulaic' and arm = 'c' as skipped from (select ['prose', 'fact', 'formulaic'][(item_id % 3)::int + 1] as register from benchmark), (select unnest(['a', 'c']) as arm) group by 1, 2")
def stored_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and skipped ones, written and read back."""
    path = folder(spark, "worklist")
    bank = scans.task_bank(spark, tasks(spark, sf_dir))
    arms, skip = spark.createDataFrame([("a",), ("c",)], "arm string"), spark.createDataFrame([("formulaic", "c", "no letters")], "register string, arm string, reason string")
    sinks.worklist(*experiment.worklist(bank, arms, skip), path)
    rows = sinks.read_worklist(spark, path, "task_id string, arm string, register string, len_class string, reason string, skipped boolean")
    return rows.groupBy("register", "arm").agg(F.count("*").alias("n"), F.bool_or("skipped").alias("skipped"))


@query("select code, kind, md5(t) as digest, place from (select *, row_number() over (order by code) - 1 as place from (select 'za' || lpad(n::varchar, 4, '0') as code, 'frame' as kind, t from (select t, row_number() over (order by f, t) as n from (select text as t, min(item_id) as f from benchmark group by 1))))")
def stored_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes written in their order: the same bytes for the same dictionary."""
    from quillspark.operators import mining

    path = folder(spark, "codes")
    codes = mining.frame_codes(read(spark, sf_dir, "benchmark"), "text", ["item_id"]).select("code", F.lit("frame").alias("kind"), "text")
    sinks.dictionary(codes, path)
    rows = spark.read.schema("code string, kind string, text string").json(path).withColumn("place", F.monotonically_increasing_id())
    return rows.select("code", "kind", F.md5("text").alias("digest"), "place")


@query("select conv_id, turn, md5(text || chr(10) || role) as digest, 1::bigint as version from conversations")
def payload_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded text of several lines within a payload, and back."""
    rows = read(spark, sf_dir, "conversations")
    payload = sinks.payload_text(1, F.concat("text", F.lit("\n"), "role"), F.struct(F.col("turn").alias("turn")))
    return rows.select("conv_id", "turn", payload.alias("p")).select("conv_id", "turn", F.md5(sinks.payload_coded(F.col("p"))).alias("digest"), F.get_json_object("p", "$.version").cast("bigint").alias("version"))


@query("select lang, count(*) as n, round(avg(quality), 6) as rate from labels join documents using (doc_id) group by lang")
def stored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as canonical lines, read back."""
    path = folder(spark, "summary")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    sinks.summary_json(read(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("rate")), path)
    return scans.artifact(spark, path, "lang string, n bigint, rate double") if spark.read.text(path).count() == 1 else spark.read.schema("lang string, n bigint, rate double").json(path)


# --- regrading ----------------------------------------------------------------------------------------------------


def regraded(spark: SparkSession, sf_dir: str) -> regrade.Regrade:
    return regrade.conditions_run(ledger(spark, sf_dir), scans.passages(scans.task_bank(spark, tasks(spark, sf_dir))))


_BLOCKS = f"""(select c as condition, coalesce(n, 0) as n, coalesce(correct, 0) as correct from (select unnest({list(regrade.CONDITIONS)}) as c) left join
  (select 'A-FROM-PLAIN' as condition, count(*) as n, count(*) filter (where anchored and plain_match) as correct from {_GRADED} union all
   select 'A-FROM-COMPRESSED', count(*), count(*) filter (where anchored and short_match) from {_GRADED}) b on b.condition = c)"""


@query(f"select condition, n, correct, round(correct / nullif(n, 0)::double, 6) as accuracy, {_wilson('correct', 'n', '-')} as wilson_lo, {_wilson('correct', 'n', '+')} as wilson_hi from {_BLOCKS}")
def regrade_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regraded(spark, sf_dir).blocks


@query(f"""
select n_pairs, both_, only_x, only_y, neither, {_mcnemar('only_x', 'only_y', 'n_pairs')} as p, round((both_ + only_y) / nullif(both_ + only_x, 0)::double, 6) as ratio
from (select count(*) as n_pairs, count(*) filter (where x and y) as both_, count(*) filter (where x and not y) as only_x, count(*) filter (where not x and y) as only_y, count(*) filter (where not x and not y) as neither
  from (select anchored and plain_match as x, anchored and short_match as y from {_GRADED}))
""")
def regrade_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both conditions of the stored run, paired by task, index and question."""
    return regraded(spark, sf_dir).mcnemar.withColumnRenamed("both", "both_")


@query(f"""
select count(*) as n_pairs, round(100 * (1 - sum(c) / sum(n)::double), 2) as savings_sum, round(100 * (1 - avg(c) / avg(n)), 2) as savings_mean, round(100 * (1 - median(c) / median(n)), 1) as savings_median, round(avg(100 * (1 - c / n::double)), 2) as savings_unit_mean
from (select {_cost('text')} as n, ceil({_cost('text')} / 2.0)::bigint as c from benchmark)
""")
def regrade_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regraded(spark, sf_dir).tokens


@query(f"""
select case when grouping(register) = 0 then 'register' when grouping(task_id) = 0 then 'task_id' when grouping(q_type) = 0 then 'q_type' else 'overall' end as grain, coalesce(register, task_id) as key, count(*) as n,
  count(*) filter (where anchored and plain_match) as correct from (select *, null::varchar as q_type from {_GRADED}) group by grouping sets ((), (q_type), (register), (task_id))
""")
def quiz_regrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline run graded again, by all grains."""
    _, grains = regrade.quiz_run(ledger(spark, sf_dir), scans.passages(scans.task_bank(spark, tasks(spark, sf_dir))))
    return grains.select("grain", "key", "n", "correct")


@query(f"""
with j as (select plain = expected as hit, case q when 1 then 'grader_wrong' when 2 then 'unparsed' else 'wrong' end as v from {_QUIZ_SQL} where plain <> expected or q = 0)
select (select count(*) from {_QUIZ_SQL}) as n, (select count(*) from {_QUIZ_SQL} where plain = expected) as correct, count(*) as judged, count(*) filter (where not hit) as judged_misses, count(*) filter (where hit) as judged_hits,
  count(*) filter (where not hit and v = 'grader_wrong') as false_negatives, count(*) filter (where hit and v = 'wrong') as false_positives, count(*) filter (where v = 'unparsed') as unparsed,
  round(count(*) filter (where not hit and v = 'grader_wrong') / count(*) filter (where not hit)::double, 6) as fn_rate, round(count(*) filter (where hit and v = 'wrong') / count(*) filter (where hit)::double, 6) as fp_rate from j
""")
def baseline_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = regrade.baseline_summary(ledger(spark, sf_dir))
    return row.select("n", "correct", "judged", "judged_misses", "judged_hits", "false_negatives", "false_positives", "unparsed", "fn_rate", "fp_rate")


@query(f"""
with v as (select anchored and plain_match as x, anchored and short_match as y, row_number() over (order by item_id, q) as k from {_GRADED}), t as (select {_cost('text')} as n from benchmark)
select count(*) as n, count(*) filter (where y) as correct, count(*) as n_source, count(*) filter (where x) as source_correct, count(*) as n_pairs, count(*) filter (where x and not y) as only_x, count(*) filter (where y and not x) as only_y,
  round((count(*) filter (where y) * count(*))::double / (count(*) filter (where x) * count(*)), 6) as ratio, (select round(avg(n), 2) from t) as plain_tokens, (select round(avg(ceil(n / 2.0)), 2) from t) as short_tokens from v
""")
def decode_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from compressed records against the source run's."""
    rows = ledger(spark, sf_dir)
    verdicts = scans.source_verdicts(rows, None, scans.passages(scans.task_bank(spark, tasks(spark, sf_dir))))
    side = lambda c: verdicts.where(F.col("condition") == c).drop("condition")
    row = regrade.decode_summary(side("A-FROM-COMPRESSED"), side("A-FROM-PLAIN"), scans.source_tokens(rows))
    return row.select("n", "correct", "n_source", "source_correct", "n_pairs", "only_x", "only_y", "ratio", F.col("R-PLAIN").alias("plain_tokens"), F.col("R-CABLESE").alias("short_tokens"))


@query(f"""
with b as (select case when quality = 1 then 'good' else 'bad' end as condition, count(*) as n, count(*) filter (where toxic = 0) as correct from labels group by 1), s as (select avg((toxic = 0)::int) as a from labels)
select condition, n, correct, round(round(correct / n::double, 6) / a, 4) as ratio from b, s
""")
def readability_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = read(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("condition"), (F.col("toxic") == 0).alias("correct"))
    return regrade.readability(answers, answers.select("correct")).select("condition", "n", "correct", "ratio")


@query("""
with a as (select o_custkey as task_id, arg_max(o_totalprice > 150000, o_orderkey) as x from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey as task_id, arg_max(o_totalprice > 150000, o_orderkey) as y from orders where o_orderstatus = 'O' group by 1)
select count(*) as n_pairs, count(*) filter (where x and y) as both_, count(*) filter (where x and not y) as only_x, count(*) filter (where y and not x) as only_y, count(*) filter (where not x and not y) as neither from a join b using (task_id)
""")
def paired_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two record sets, each reduced to its last attempt, paired by key."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), "o_orderkey", "o_orderstatus", (F.col("o_totalprice") > 150000).alias("correct"))
    side = lambda s: ordering.last_attempt(rows.where(F.col("o_orderstatus") == s).drop("o_orderstatus"), ["task_id"], ["o_orderkey"])
    cells = joins.paired(side("F"), side("O"), ["task_id"]).agg(*stats.mcnemar_cells(F.col("x"), F.col("y")))
    return cells.withColumnRenamed("both", "both_")


@query(f"""
with u as (select conv_id, turn, text from conversations where role = 'user'), a as (select conv_id, turn - 1 as turn, text as direct from conversations where role = 'assistant')
select conv_id, turn, {_jaccard('x', 'y')} as similarity from (select conv_id, turn, {_set(_lex('text'))} as x, {_set(_lex("coalesce(direct, '')"))} as y from u left join a using (conv_id, turn))
""")
def decode_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn against the reply to it; one without a reply scores 0."""
    rows = read(spark, sf_dir, "conversations")
    direct = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("direct"))
    return joins.with_similarity(rows.where("role = 'user'").select("conv_id", "turn", "text"), direct, ["conv_id", "turn"], "text", "direct").select("conv_id", "turn", "similarity")


# --- experiments --------------------------------------------------------------------------------------------------


@query("""
with v as (select event_type as variant, sum(event_id % 50)::bigint as bundle, count(*)::bigint as cost from events group by 1), b as (select bundle as base from v where variant = 'view')
select variant, base - bundle as saving, case when base - bundle > 0 then case when cost > 0 then ceil(cost / (base - bundle)::double)::bigint else 1 end end as turns from v, b
""")
def variant_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant")).agg(F.sum(F.col("event_id") % 50).alias("bundle_approx_tokens"), F.count("*").alias("transform_cost_tokens"))
    return experiment.variants(rows, "view").select("variant", F.col("per_turn_saving_approx_tokens").alias("saving"), F.col("break_even_turns").alias("turns"))


_BILLS = "(select event_id, case when event_id % 2 = 0 then 'p' else 'c' end as c, 100 + event_id % 37 - case when event_id % 2 = 1 then 40 else 0 end as billed, case when event_id % 3 = 0 then event_id % 11 end as hidden, 10 + event_id % 5 as approx, (event_id % 90)::double as ms from events)"


@query(f"""
with b as {_BILLS}, p as (select *, billed - coalesce(hidden, 0) as visible from b)
select count(*) as n, count(*) filter (where visible < billed) as rows_with_reasoning, round(100 * (1 - median(billed) filter (where c = 'c') / median(billed) filter (where c = 'p')), 1) as billed_savings_median,
  round(100 * (1 - sum(billed) filter (where c = 'c') / (sum(billed) filter (where c = 'p'))::double), 1) as billed_savings_sum, round(100 * (1 - median(visible) filter (where c = 'c') / median(visible) filter (where c = 'p')), 1) as visible_savings_median,
  round(100 * (1 - sum(visible) filter (where c = 'c') / (sum(visible) filter (where c = 'p'))::double), 1) as visible_savings_sum, median(ms) filter (where c = 'p') as plain_ms, median(ms) filter (where c = 'c') as compressed_ms from p
""")
def billing_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    hidden, billed = F.when(i % 3 == 0, i % 11), 100 + i % 37 - F.when(i % 2 == 1, 40).otherwise(0)
    usage = F.struct(F.lit(0).cast("bigint").alias("prompt_tokens"), billed.cast("bigint").alias("completion_tokens"), billed.cast("bigint").alias("total_tokens"), hidden.cast("bigint").alias("reasoning_tokens"))
    rows = read(spark, sf_dir, "events").select(F.lit("t").alias("task_id"), F.when(i % 2 == 0, "p").otherwise("c").alias("condition"), usage.alias("usage"), (10 + i % 5).alias("approx_tokens"), (i % 90).cast("double").alias("latency_ms"))
    return experiment.billing(rows, "p", "c").drop("approx_savings_median", "approx_savings_sum")


@query("""
with f as (select l_orderkey as task_id, case when l_orderkey < 30 then 'rare' when l_orderkey % 3 = 0 then 'short' else 'long' end as len_class, l_tax >= 0 as ok, l_discount < 0.06 as v from lineitem),
t as (select task_id, len_class, avg(v::int) as rate from f group by 1, 2 having bool_and(ok) and avg(v::int) >= 0.6), e as (select len_class from t group by 1 having count(*) >= 20)
select len_class, count(*) as n from t where len_class in (select len_class from e) group by 1
""")
def generation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated tasks that verify enough facts, of classes that have enough of them."""
    key = F.col("l_orderkey")
    kind = F.when(key < 30, "rare").when(key % 3 == 0, "short").otherwise("long")
    facts = read(spark, sf_dir, "lineitem").select(key.alias("task_id"), kind.alias("len_class"), (F.col("l_tax") >= 0).alias("parse_ok"), (F.col("l_discount") < 0.06).alias("verified"))
    return experiment.accepted_tasks(facts, 0.6, 20).groupBy("len_class").agg(F.count("*").alias("n"))


@query(f"select lang as name, round(avg(quality), 6) as got, 0.85::double as claim, abs(round(avg(quality), 6) - 0.85::double) <= 0.05 as ok from {LABELLED} group by lang")
def claims_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    rates = read(spark, sf_dir, "labels").join(docs, "doc_id").groupBy(F.col("lang").alias("name")).agg(F.round(F.avg("quality"), 6).alias("got"))
    return experiment.checked(rates.withColumn("claim", F.lit(0.85)), 0.05)


@query("select o_orderkey as left_key, l as right_key from (select o_orderkey, row_number() over (order by o_orderkey) as k from orders) join (select c_custkey as l, row_number() over (order by c_custkey) as k from customer) using (k)")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.zipped(read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "customer").select("c_custkey"), "o_orderkey", "c_custkey", ("left_key", "right_key"))


@query("select true as apart, false as same")
def sessions_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test share no session; each shares all with itself."""
    rows = ordering.split_sessions(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    return spark.createDataFrame([(experiment.sessions_are_apart(train, test, "user_id"), experiment.sessions_are_apart(train, train, "user_id"))], "apart boolean, same boolean")


@query("select conv_id, len(list_filter(list(text order by turn), lambda x: trim(x) <> ''))::int as n from conversations group by 1")
def valid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with an empty question or answer go."""
    items = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.trim("text").alias("q"), F.col("role").alias("a"))).alias("items"))
    return dedupe.valid_items(items, "items").select("conv_id", F.size("items").alias("n"))


# --- functions ----------------------------------------------------------------------------------------------------


@query(f"""
with t as (select item_id, text, array_to_string(string_split(text, ' ')[2:5], ' ') as part from benchmark),
v as (select item_id, text, k, case k when 0 then part when 1 then 'zz ' || part when 2 then '' else text end as answer from t, range(4) r(k))
select item_id, k, {_lex('answer')} <> '' and contains({_lex('text')}, {_lex('answer')}) as verified from v
""")
def answer_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of its text, the part with another word, nothing, the whole; none of those that aren't contained is as near
    as 0.98 to the whole."""
    part = F.array_join(F.slice(F.split("text", " "), 2, 4), " ")
    rows = read(spark, sf_dir, "benchmark").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    answer = F.when(F.col("k") == 0, part).when(F.col("k") == 1, F.concat(F.lit("zz "), part)).when(F.col("k") == 2, "").otherwise(F.col("text"))
    return rows.select("item_id", "k", python.answer_verified(answer, F.col("text")).alias("verified"))


@query(f"select doc_id, 1 as version, md5(text) as original, md5(coded) as coded, n_applied from {_coded_sql()}")
def router_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's layer, then the register's, which has no rules here and so leaves its input as it is but for
    runs of blanks, of which the tables have none."""
    encode = codec.router_encoder(BOOK, codec.Rules(articles=(), copulas=(), verb_endings=()))
    rows = read(spark, sf_dir, "documents").select("doc_id", encode(F.col("text")).alias("e"))
    return rows.select("doc_id", "e.version", F.md5("e.original").alias("original"), F.md5("e.coded").alias("coded"), F.size("e.dictionary.applied").alias("n_applied"))


_LOSS = "'the cat is ' || event_type || ' between a dog and an information desk'"


@query(f"""
select event_id, 'articles dropped: 3; copulas dropped: ' || c || '; words derived: 2; lossy: true' as summary, md5(array_to_string(list_filter(['dropped article the at 0', case when c = 1 then 'dropped copula is at 8' end,
  'derived between as btwn at ' || (12 + n), 'dropped article a at ' || (20 + n), 'dropped article an at ' || (30 + n), 'derived information as info at ' || (33 + n)], lambda x: x is not null), '|')) as report
from (select event_id, length(event_type) as n, case when event_type like '%ing' or event_type like '%ed' then 0 else 1 end as c from events)
""")
def loss_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = codec.register_encoder(RULES)
    rows = read(spark, sf_dir, "events").select("event_id", encode(F.expr(_LOSS)).alias("e"))
    report = text.loss_report(F.col("e.dropped"), F.col("e.derived"))
    return rows.select("event_id", codec.loss_summary(F.col("e.dropped"), F.col("e.derived")).alias("summary"), F.md5(F.array_join(report, "|")).alias("report"))


@query("select n_regionkey as region, n_name as name, n_nationkey::int as key from nation")
def map_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of keys to names for each region, turned round, and its entries."""
    maps = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    return maps.select("region", F.explode(text.inverted(F.col("m"))).alias("name", "key"))


@query("select r_regionkey, '=== nations legend ===' || chr(10) || coalesce(string_agg(n_nationkey || chr(9) || n_name, chr(10) order by n_nationkey::varchar), '') || chr(10) as legend from region join nation on n_regionkey = r_regionkey group by 1")
def legend_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("text"))).alias("entries"))
    return rows.select("r_regionkey", text.legend(F.col("entries"), "nations").alias("legend"))


@query(f"select event_id, case when contains(raw, 'Wrong') then 'a' when contains(raw, 'PARTIAL') then 'b' else 'none' end as answer from (select event_id, coalesce({_REPLY}, '') as raw from events)")
def stub_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.coalesce(F.expr(_REPLY), F.lit(""))
    return read(spark, sf_dir, "events").select("event_id", scans.stub_answer(prompt, [("Wrong", "a"), ("PARTIAL", "b")], "none").alias("answer"))


@query(f"select conv_id, turn, md5({_norm('text')}) as digest, {_cost('text')} as approx_tokens, {_jaccard(_set(_norm('text')), _set(_norm('role')))} as similarity from conversations")
def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel as SQL functions."""
    functions.register(spark)
    read(spark, sf_dir, "conversations").createOrReplaceTempView("quill_conversations")
    return spark.sql("select conv_id, turn, md5(quill_normalize(text)) as digest, quill_approx_count(text) as approx_tokens, quill_jaccard(text, role) as similarity from quill_conversations")


# --- streams ------------------------------------------------------------------------------------------------------


@query(f"select condition, n, correct from {_BLOCKS} where n > 0")
def streamed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts that arrive as files, appended exactly once to a stored ledger; two runs of the stream add nothing twice."""
    source, path = folder(spark, "arriving"), folder(spark, "streamed")
    rows = regraded(spark, sf_dir).rows.select(F.lit("cond_answer").alias("type"), "task_id", "condition", "q_index", "correct")
    rows.repartition(4, "task_id").write.json(source)
    for _ in range(2):
        stream.append_new(stream.records(spark, source), path, f"{path}-state").awaitTermination()
    return spark.read.schema(schemas.LEDGER).parquet(path).groupBy("condition").agg(*stats.accuracy_block(F.col("correct")))


@query("select user_id, strftime(ts, '%Y-%m-%d %H') as start, count(*) as n, sum(event_id)::bigint as total from events group by 1, 2")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour of events that arrive in several files, a batch each, each event once. Each batch adds what it has
    changed to a stored table, and the last of each window counts."""
    source, out = folder(spark, "arriving"), folder(spark, "windows")
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(4, "event_id").write.parquet(source)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    counted = stream.windowed(stream.distinct(arriving, ["event_id"], "ts", "100000 days"), "ts", "1 hour", ["user_id"], "event_id", "100000 days")

    def put(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    counted.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    latest = ordering.last_attempt(spark.read.parquet(out), ["user_id", "window"], ["batch"])
    return latest.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "n", F.col("total").cast("bigint").alias("total"))


_GRAINS = f"select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' else 'overall' end as grain, coalesce(lang, source) as key, count(*) as n, count(*) filter (where quality = 1) as correct from {LABELLED} group by grouping sets ((), (lang), (source))"


@query(_GRAINS)
def sliced_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary from sums by slice, after one slice ran with half of its answers and then again with all."""
    path = folder(spark, "slices")
    rows = verdicts(spark, sf_dir).withColumn("slice", F.col("doc_id") % 7)
    runs.put_slices(rows.where("slice <> 3 or doc_id % 2 = 0"), path, "slice", ["lang", "source"], "x")
    runs.put_slices(rows.where("slice = 3"), path, "slice", ["lang", "source"], "x")
    return runs.slice_summary(spark, path, ["lang", "source"]).select("grain", "key", "n", "correct")


@query(ORACLES["last_attempt_wins"])
def bucketed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``last_attempt_wins`` after three appends, one of them twice, and a compaction."""
    store = runs.RunStore(spark, folder(spark, "runs"), ["user_id", "event_type"], ["ts", "event_id"])
    events = read(spark, sf_dir, "events")
    for run in (0, 1, 2, 2):
        store.append(events.where(F.col("event_id") % 3 == run), run)
    store.compact()
    return store.read().select("user_id", "event_type", "event_id", "value")


#: Rows of a file of a stream, about.
FILE_ROWS = 2_000_000


def _arriving(rows: DataFrame, name: str, key: str, batches: int = 2) -> DataFrame:
    """Rows as a stream of several batches, which a unit's rounds are dealt over; a batch has as many files as its rows need."""
    spark, source = rows.sparkSession, folder(rows.sparkSession, name)
    rows = written(rows.withColumn("ts", F.lit("2026-01-01").cast("timestamp")), name)
    files = max(1, -(-rows.count() // (batches * FILE_ROWS)))
    by = ["place"] if files == 1 else ["place", key]
    rows.repartition(batches * files, *by).drop("place").write.parquet(source)
    return spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files).parquet(source)


@query(ORACLES["brake_ladder"])
def streamed_brake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``brake_ladder``, of levels that arrive out of order over several batches."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("score"), F.lit(11.0).alias("b"), F.col("l_linenumber").alias("place"))
    found, out = units.decided(_arriving(rows, "levels", "l_orderkey"), ["l_orderkey"], "l_linenumber", ["score", "b"], "ts", units.brake, units.BRAKE), folder(spark, "braked")
    units.put_updates(found, out, f"{out}-state").awaitTermination()
    return units.latest(spark.read.parquet(out), ["l_orderkey"]).drop("final")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks by order and round, after a single exchange of the line items."""
    rows = read(spark, sf_dir, "lineitem").where("l_orderkey is not null")
    first = F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))
    rows = rows.select("l_orderkey", "l_quantity", (F.col("l_linenumber") - first).cast("int").alias("round"))
    return rows.groupBy("l_orderkey", "round").agg((F.min("l_quantity") >= 3).alias("parse_ok"), F.least(F.max("l_quantity").cast("bigint"), F.lit(40)).alias("matched"), F.lit(40).alias("total"))


@query(ORACLES["repair_replay"])
def streamed_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``repair_replay``, of checks that arrive out of order over several batches."""
    checks = _checks(spark, sf_dir)
    found, out = units.decided(_arriving(checks.withColumn("place", -F.col("round")), "checks", "l_orderkey"), ["l_orderkey"], "round", ["parse_ok", "matched", "total"], "ts", units.repairs(2), units.REPAIRS), folder(spark, "repaired")
    units.put_updates(found, out, f"{out}-state").awaitTermination()
    return units.latest(spark.read.parquet(out), ["l_orderkey"]).drop("final")


_LABEL_LINE = """'{"type":"quiz_item","task_id":"d' || doc_id || '","q_index":' || quality || ',"condition":"' || case toxic when 1 then 'T' else 'C' end || '"}'"""


@query(f"select doc_id % 7 <> 0 as readable, md5(case when doc_id % 7 <> 0 then 'd' || doc_id || ':' || quality else left(l, length(l) - 5) end) as digest, count(*) as n from (select *, {_LABEL_LINE} as l from labels) group by 1, 2")
def stored_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as lines of a ledger, every seventh broken off: what can be read and what can't is all of them."""
    condition = F.when(F.col("toxic") == 1, "T").otherwise("C")
    line = F.to_json(F.struct(F.lit("quiz_item").alias("type"), F.concat(F.lit("d"), "doc_id").alias("task_id"), F.col("quality").alias("q_index"), condition.alias("condition")))
    cut = F.when(F.col("doc_id") % 7 == 0, F.expr("left(line, length(line) - 5)")).otherwise(F.col("line"))
    lines = read(spark, sf_dir, "labels").withColumn("line", line).select((F.col("doc_id") % 3).cast("int").alias("file"), cut.alias("value"))
    found = scans.quarantined(spark, text_files(lines, folder(spark, "tolerant"), ["a.jsonl", "b.jsonl", "c.jsonl"]))
    good = scans.readable(found, "quiz_item", ["T", "C"]).select(F.lit(True).alias("readable"), F.md5(F.concat("task_id", F.lit(":"), "q_index")).alias("digest"))
    bad = scans.rejected(found).select(F.lit(False).alias("readable"), F.md5(scans.BROKEN).alias("digest"))
    return good.unionByName(bad).groupBy("readable", "digest").agg(F.count("*").alias("n"))


@query(f"select 't' || item_id as task_id, md5(left(text, length(text) // 2)) as digest, {_cost('text')} as plain_tokens from benchmark")
def stored_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one condition, used again beside the costs of their tasks' texts."""
    rows = read(spark, sf_dir, "benchmark")
    half = F.expr("left(text, length(text) div 2)")
    record = lambda c, t: F.struct(F.lit("record").alias("type"), F.concat(F.lit("t"), "item_id").alias("task_id"), F.lit(c).alias("condition"), t.alias("text"), text.approx_count("text").alias("approx_tokens"))
    lines = rows.select((F.col("item_id") % 2).cast("int").alias("file"), F.explode(F.array(record("R-PLAIN", F.col("text")), record("R-CABLESE-LOWERCASE", half))).alias("r")).select("file", F.to_json("r").alias("value"))
    found = scans.ledger(spark, text_files(lines, folder(spark, "reused"), ["a.jsonl", "b.jsonl"]))
    used = scans.reused_records(found).select("task_id", F.md5("text").alias("digest"))
    return used.join(found.where("condition = 'R-PLAIN'").select("task_id", F.col("approx_tokens").alias("plain_tokens")), "task_id")


@query(f"select condition, n, correct from {_BLOCKS} where n > 0")
def stored_regraded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regraded rows, written and read back as verdicts."""
    path = folder(spark, "regraded")
    sinks.regraded_rows(regraded(spark, sf_dir).rows, path)
    rows = spark.read.schema(schemas.LEDGER).json(path)
    return rows.groupBy("condition").agg(*stats.accuracy_block(F.col("correct")))
