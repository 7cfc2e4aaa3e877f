"""Scans. Every reader takes a path that Spark can open, with an explicit schema, so that filters and columns are pushed down."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import approx_count
from quillspark.operators.codec import Entry, Rules
from quillspark.sources import schemas

#: Bounds of the scan for tool definitions.
MOST_FILES, MOST_BYTES = 400, 3_000_000


class ScanError(ValueError):
    """An input that a scan refuses."""


def task_bank(spark: SparkSession, folder: str, drop_register: str | None = None, pattern: str = "*.json") -> DataFrame:
    """One JSON object per file, not READMEs, by id. ``drop_register`` is pushed into the scan."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    tasks = spark.read.schema(schemas.TASK).option("multiLine", True).option("pathGlobFilter", pattern).json(folder)
    tasks = tasks.where(~name.startswith("README"))
    if drop_register is not None:
        tasks = tasks.where(~F.col("register").eqNullSafe(drop_register))
    return tasks.orderBy("id")


def numbered_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Files task_*.json only, in the order of their names."""
    tasks = spark.read.schema(schemas.TASK).option("multiLine", True).option("pathGlobFilter", "task_*.json").json(folder)
    return tasks.withColumn("_file", F.input_file_name()).orderBy("_file").drop("_file")


def ledger_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct non-blank lines of text files, by their digest: appended twice counts once."""
    if not paths:
        raise ScanError("no ledger files")
    lines = spark.read.text(list(paths)).select(F.trim("value").alias("value")).where("value <> ''")
    return lines.withColumn("digest", F.sha2("value", 256)).dropDuplicates(["digest"])


def ledger(spark: SparkSession, *paths: str, tolerant: bool = False) -> DataFrame:
    """Records of a ledger and its slices, each line once. A broken line is an error, or left out where ``tolerant``."""
    lines = ledger_lines(spark, *paths)
    mode = "PERMISSIVE" if tolerant else "FAILFAST"
    parsed = lines.select(F.from_json("value", schemas.LEDGER, {"mode": mode}).alias("r"), F.get_json_object("value", "$.type").alias("t"))
    if tolerant:
        parsed = parsed.where(F.col("t").isNotNull())
    return parsed.select("r.*")


#: Column of a line that can't be read, as it stands.
BROKEN = "broken_line"


def quarantined(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of a ledger, every line of every file: one that can't be read is a row with nothing but ``broken_line`` and its
    ``file``. Files are split where they are large; filters on types and conditions go down to the scan, where lines
    that fail them aren't parsed any further. ``readable`` and ``rejected`` take either kind."""
    if not paths:
        raise ScanError("no ledger files")
    found = spark.read.schema(f"{schemas.LEDGER}, {BROKEN} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(list(paths))
    # Spark looks at no more fields than a query asks for, and a line is broken by what is looked at: all are asked for
    fields = [F.map_entries(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in found.schema.fields]
    return found.where(F.xxhash64(*fields) >= F.lit(-(2**63))).withColumn("file", F.col("_metadata.file_name"))


def readable(found: DataFrame, kind: str | None = None, conditions: list[str] | None = None) -> DataFrame:
    """Those records of a quarantined scan that can be read, of a type and of some conditions."""
    rows = found if kind is None else found.where(F.col("type") == kind)
    rows = rows if conditions is None else rows.where(F.col("condition").isin(conditions))
    return rows.where(F.col(BROKEN).isNull()).drop(BROKEN)


def rejected(found: DataFrame) -> DataFrame:
    """``file, broken_line`` of lines that can't be read."""
    return found.where(F.col(BROKEN).isNotNull()).select("file", BROKEN)


def slices(spark: SparkSession, folder: str) -> DataFrame:
    """Records of slice_*.jsonl, none of partial or stub files; a broken line is an error."""
    return spark.read.schema(schemas.LEDGER).option("mode", "FAILFAST").option("pathGlobFilter", "slice_?*.jsonl").json(folder)


def shards(spark: SparkSession, folder: str, existing: DataFrame | None = None) -> DataFrame:
    """Shard records and those of a former merge, each once, so that merging again changes nothing."""
    found = spark.read.schema(schemas.LEDGER).option("pathGlobFilter", "*.jsonl").json(folder)
    both = found if existing is None else found.unionByName(existing, allowMissingColumns=True)
    key = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(both.columns)])), 256)
    return both.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")


def view(records: DataFrame, kind: str) -> DataFrame:
    """Records of one type with its own columns; the type filter prunes partitions of a stored ledger."""
    columns = [c for c in (*schemas.STAMP, *schemas.VIEWS[kind]) if c in records.columns]
    return records.where(F.col("type") == kind).select(*columns)


def guarded_source(records: DataFrame, tasks: DataFrame, plain: str = "R-PLAIN", compressed: str = "R-CABLESE", quota: int | None = None) -> DataFrame:
    """Each task's quiz items with both of its records; an error if any task lacks items or a record.

    Items come first-k by ``quota`` in the order of ``q_index``; of several records the last attempt counts.
    """
    from quillspark.operators.ordering import first_k, last_attempt

    items = view(records, "quiz_item")
    items = first_k(items, ["task_id"], ["q_index", "question"], quota) if quota else items
    texts = last_attempt(records.where(F.col("type") == "record"), ["task_id", "condition"], ["attempt", "run_id", "text"])
    both = texts.groupBy("task_id").pivot("condition", [plain, compressed]).agg(F.first("text"))
    both = both.withColumnRenamed(plain, "plain").withColumnRenamed(compressed, "compressed")
    complete = items.select("task_id").distinct().join(both.where("plain is not null and compressed is not null"), "task_id", "left_semi")
    missing = tasks.select(F.col("id").alias("task_id")).join(complete, "task_id", "left_anti").limit(5).collect()
    if missing:
        raise ScanError("source run is incomplete: " + ", ".join(sorted(r.task_id for r in missing)))
    return items.join(both, "task_id")


def source_verdicts(records: DataFrame, regraded: DataFrame | None, passages: DataFrame) -> DataFrame:
    """``task_id, condition, q_index, question, correct``: regraded rows if there are any, else graded again."""
    from quillspark.functions.text import grade

    keys = ["task_id", "condition", "q_index", "question"]
    if regraded is not None:
        return regraded.select(*keys, "correct")
    answers = view(records, "cond_answer").join(passages.select("task_id", "passage"), "task_id")
    return answers.select(*keys, grade("expected", "raw_answer", "passage")["correct"].alias("correct"))


def source_tokens(records: DataFrame) -> DataFrame:
    """``task_id, condition, approx_tokens`` of the last attempt at each record."""
    rows = records.where((F.col("type") == "record") & F.col("approx_tokens").isNotNull())
    return rows.groupBy("task_id", "condition").agg(F.max_by("approx_tokens", F.struct(F.coalesce("attempt", F.lit(0)), "run_id", "approx_tokens")).alias("approx_tokens"))


def reused_records(records: DataFrame, condition: str = "R-CABLESE-LOWERCASE") -> DataFrame:
    return view(records, "record").where(F.col("condition") == condition)


def passages(tasks: DataFrame, overrides: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """``task_id, passage``: a map of overrides (one row, one map column) wins over the bank. Of the ids that are
    ``wanted`` (``task_id``), one without a passage is an error."""
    found = _passages(tasks, overrides)
    if wanted is not None:
        lost = wanted.select("task_id").distinct().join(found.where("passage is not null"), "task_id", "left_anti").limit(5).collect()
        if lost:
            raise ScanError("no passage for: " + ", ".join(sorted(str(r.task_id) for r in lost)))
    return found


def _passages(tasks: DataFrame, overrides: DataFrame | None) -> DataFrame:
    bank = tasks.select(F.col("id").alias("task_id"), "passage")
    if overrides is None:
        return bank
    own = overrides.select(F.explode(F.col(overrides.columns[0])).alias("task_id", "own"))
    both = bank.join(own, "task_id", "full").select("task_id", F.coalesce("own", "passage").alias("passage"))
    return both


def resolved(answers: DataFrame, known: DataFrame, key: str = "task_id") -> DataFrame:
    """Inner lookup that refuses a row without a match."""
    lost = [r[0] for r in answers.join(known, key, "left_anti").select(key).distinct().limit(5).collect()]
    if lost:
        raise ScanError(f"no match for {key}: " + ", ".join(map(str, sorted(lost, key=str))))
    return answers.join(known, key)


def codebook(spark: SparkSession, folder: str) -> DataFrame:
    """``table, code, expansion, case_sensitive`` of a folder of JSON tables ({"name", "entries"}), in the one order that all use."""
    tables = spark.read.schema(f"name string, entries array<struct<{schemas.CODEBOOK.replace(' string', ':string').replace(' boolean', ':boolean')}>>").option("multiLine", True).json(folder)
    rows = tables.select(F.col("name").alias("table"), F.inline("entries")).withColumn("case_sensitive", F.coalesce("case_sensitive", F.lit(True)))
    return rows.orderBy(F.desc(F.length("expansion")), F.lower("expansion"), F.lower("code"))


def codebook_faults(entries: DataFrame) -> DataFrame:
    """``fault, table, code``: missing fields, a code twice (in any case, in any table), a code that is another's expansion."""
    missing = entries.where("code is null or code = '' or expansion is null or expansion = ''").select(F.lit("missing field").alias("fault"), "table", "code")
    twice = entries.groupBy(F.lower("code").alias("k")).agg(F.count("*").alias("n"), F.min("table").alias("table"), F.min("code").alias("code")).where("n > 1")
    twice = twice.select(F.lit("duplicate code").alias("fault"), "table", "code")
    other = entries.select(F.col("table").alias("other"), F.lower("expansion").alias("k")).distinct()
    clash = entries.withColumn("k", F.lower("code")).join(other, "k").where(F.col("table") != F.col("other"))
    clash = clash.select(F.lit("code is an expansion").alias("fault"), "table", "code").distinct()
    return missing.unionByName(twice).unionByName(clash)


def entries_of(codebook_: DataFrame) -> list[Entry]:
    """A codebook, small by nature, for the codecs. Refused if it has faults."""
    faults = codebook_faults(codebook_).limit(5).collect()
    if faults:
        raise ScanError("codebook: " + "; ".join(f"{f.fault} {f.code!r} in {f.table}" for f in faults))
    return [Entry(r.code, r.expansion, bool(r.case_sensitive), r.table) for r in codebook_.collect()]


def rules(spark: SparkSession, path: str) -> Rules:
    """Register rules of one JSON file: lists have to be sorted, derived forms unique."""
    row = spark.read.schema(schemas.RULES).option("multiLine", True).json(path).first()
    if row is None or any(x is None for x in row):
        raise ScanError("rules: a field is missing")
    lists = [list(x) for x in row[:4]]
    if any(x != sorted(x) for x in lists):
        raise ScanError("rules: a list isn't sorted")
    derived = [d.derived for d in row.derivations]
    if len(set(derived)) < len(derived):
        raise ScanError("rules: a derived form is there twice")
    return Rules(*map(tuple, lists), {d.word: d.derived for d in row.derivations})


def frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FRAME).json(path)


def artifact(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One stored JSON document."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def text_bundle(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files with their sizes: ``path, text, chars, approx_tokens``; a missing file is an error."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.length("value").alias("chars"), approx_count("value").alias("approx_tokens"))


def tool_definitions(spark: SparkSession, folder: str, start: str, glob: str = "*.js", most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """JSON objects that follow a pattern in source files, each name once: ``name, definition``.

    At most ``most_files`` files, by name, and none above ``most_bytes``, are read: bounds of the feature itself.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    wanted = files.where(F.col("length") <= most_bytes).select("path").orderBy("path").limit(most_files)
    texts = files.join(F.broadcast(wanted), "path", "left_semi").select("path", F.col("content").cast("string").alias("text"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quillspark.functions.python import json_span

        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                for m in re.finditer(start, text):
                    block, _ = json_span(text[m.start() :])
                    if block and isinstance(x := json.loads(block), dict) and isinstance(x.get("name"), str):
                        rows.append((path, m.start(), x["name"], block))
            yield pd.DataFrame(rows, columns=["path", "at", "name", "definition"])

    hits = texts.mapInPandas(found, "path string, at int, name string, definition string")
    return hits.groupBy("name").agg(F.min_by("definition", F.struct("path", "at")).alias("definition"))


def stub_answer(prompt: Column, routes: list[tuple[str, str]], default: str) -> Column:
    """Canned answers by what a prompt contains: the first route that matches. Stands for a model in tests."""
    out = F.lit(default)
    for needle, answer in reversed(routes):
        out = F.when(F.contains(prompt, F.lit(needle)), answer).otherwise(out)
    return out
