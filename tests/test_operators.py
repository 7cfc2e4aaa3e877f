import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import containment, lexical, normalize, token_set
from quillspark.operators import aggregates, dedupe, joins, ordering


def plain_greedy(texts, threshold):
    kept, out = [], []
    for t in texts:
        s = set(t.lower().split())
        hit = None
        for k, other in enumerate(kept):
            least = min(len(s), len(other))
            o = len(s & other) / least if least else 0.0
            if o >= threshold:
                hit = (k, round(o, 6))
                break
        out.append(hit)
        if hit is None:
            kept.append(s)
    return out


def test_greedy_matches_a_loop(spark):
    rng = random.Random(4)
    rows = [(g, i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 7)))) for g in range(25) for i in range(12)]
    got = {(r.g, r.i): (r.kept, r.kept_index, r.overlap) for r in dedupe.greedy(spark.createDataFrame(rows, "g int, i int, t string"), ["g"], "i", "t").collect()}
    for g in range(25):
        for i, hit in enumerate(plain_greedy([t for x, _, t in rows if x == g], 0.6)):
            assert got[g, i] == ((True, None, None) if hit is None else (False, *hit))


def test_greedy_boundary_and_chain(spark):
    rows = [(1, 0, "a b c d e"), (1, 1, "a b c x y z"), (1, 2, "a b p q r")]
    got = {r.i: r.kept for r in dedupe.greedy(spark.createDataFrame(rows, "g int, i int, t string"), ["g"], "i", "t").collect()}
    assert got == {0: True, 1: False, 2: True}


def test_last_attempt_and_audit(spark):
    rows = [("t1", 0, 1, "old"), ("t1", 0, 2, "new"), ("t2", 0, None, "only"), ("t1", 1, 1, "x"), ("t1", 1, 1, "x")]
    df = spark.createDataFrame(rows, "task string, q int, attempt int, text string")
    got = {(r.task, r.q): r.text for r in ordering.last_attempt(df, ["task", "q"], ["attempt", "text"]).collect()}
    assert got == {("t1", 0): "new", ("t2", 0): "only", ("t1", 1): "x"}
    assert [(r.task, r.q, r.n_rows, r.n_payloads) for r in ordering.duplicate_keys(df, ["task", "q"], ["text"]).collect()] == [("t1", 0, 2, 2)]


def test_slices_tile_all_rows(spark):
    df = spark.range(50).withColumnRenamed("id", "n")
    for slots in (1, 7, 24):
        seen = [r.n for s in ordering.tiles(df, slots).collect() if s.length for r in ordering.sliced(df, ["n"], s.offset, s.length).collect()]
        assert sorted(seen) == list(range(50))
    with pytest.raises(ValueError):
        ordering.sliced(df, ["n"], 50, 1)


def test_sessions_do_not_leak(spark):
    df = spark.createDataFrame([(f"s{i % 7}", i) for i in range(50)], "session string, seq int")
    parts = ordering.split_sessions(df, "session", "seq")
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    assert joins.disjoint(train, test, ["session"]) and train.count() + test.count() == 50
    assert {r.session for r in train.select("session").distinct().collect()} == {"s0", "s2", "s4", "s6"}


@pytest.mark.parametrize("range_rows", [7, 1000])
def test_ranked_is_a_global_row_number(spark, range_rows):
    rng = random.Random(3)
    rows = [(rng.choice([None, 5, 5, rng.randrange(40)]), i) for i in range(200)]
    got = {r.i: r.rank for r in ordering.ranked(spark.createDataFrame(rows, "v int, i int"), "v", ["i"], "rank", range_rows).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {i: k for k, (_, i) in enumerate(want)}


def test_brake(spark):
    rows = [("a", 1, 9.0), ("a", 2, 3.0), ("a", 3, 9.0), ("b", 1, 1.0), ("c", 1, 8.0), ("c", 2, 9.0), ("d", 1, None)]
    df = spark.createDataFrame(rows, "u string, level int, score double").withColumn("base", F.lit(9.0))
    got = {r.u: (r.chosen, r.stopped_at, r.accepted) for r in ordering.brake(df, ["u"], "level", "score", "base").collect()}
    assert got == {"a": (1, 2, 1), "b": (0, 1, 0), "c": (2, None, 2), "d": (0, 1, 0)}


def test_hash_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a, b = (sorted(r.id for r in ordering.hash_sample(x, F.col("id"), 20, "s").collect()) for x in (df, df.repartition(13)))
    assert a == b and len(set(a)) == 20
    assert ordering.hash_sample(df.limit(5), F.col("id"), 20, "s").count() == 5


def test_anchored_join_is_the_theta_join(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(n)))
    items = spark.createDataFrame([(i, text(5)) for i in range(30)], "item int, t string")
    docs = spark.createDataFrame([(i, text(12)) for i in range(40)] + [(99, None)], "doc int, t string")
    want = items.crossJoin(docs.withColumnRenamed("t", "d")).withColumn("s", containment(token_set(normalize("t")), token_set(normalize(F.coalesce("d", F.lit("")))))).where("s >= 0.8")
    got = joins.anchored(items, docs, "item", "t", "doc", "t")
    assert {(r.item, r.doc, r.score) for r in got.collect()} == {(r.item, r.doc, round(r.s, 6)) for r in want.collect()}
    with pytest.raises(ValueError):
        joins.anchored(items, docs, "item", "t", "doc", "t", 0)


@pytest.mark.parametrize("rows", [0, 300_000])
def test_anchored_join_sends_no_passages(spark, monkeypatch, rows):
    """Shuffled or broadcast, the pairs are the same; if broadcast, no exchange has the tokens of long passages."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
    items = spark.createDataFrame([(k, f"a{k} b{k} c{k} the of") for k in range(20)], "item int, t string")
    docs = spark.createDataFrame([(k, f"a{k} b{k} c{k} the of " + " ".join(f"x{j}" for j in range(60))) for k in range(15)] + [(90, "the of"), (91, "a3 the of zz"), (92, "b19 c19")], "doc int, t string")
    got = joins.anchored(items, docs, "item", "t", "doc", "t")
    assert {(r.item, r.doc) for r in got.collect()} == {(k, k) for k in range(15)} | {(k, 90) for k in range(20)} | {(19, 92)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not rows or "SortMergeJoin" not in plan


def test_gate_and_its_complement(spark):
    df = spark.createDataFrame([("a b c", "a"), ("a b", "x y"), (None, "x"), ("a", None)], "passage string, expected string")
    kept, gone = joins.gate(df, "passage", "expected")
    assert kept.count() == 1 and gone.count() == 3


def test_stamp_does_not_override(spark):
    df = spark.createDataFrame([("own",), (None,)], "run_id string")
    assert sorted(r.run_id for r in joins.stamped(df, {"run_id": F.lit("stamp"), "sha": F.lit("x")}).collect()) == ["own", "stamp"]


def test_grains_and_missing_conditions(spark):
    df = spark.createDataFrame([("x", "p", True), ("x", "q", False), ("y", None, True)], "a string, b string, correct boolean")
    got = {(r.grain, r.key): (r.n, r.correct) for r in aggregates.accuracy_by_grain(df, ["a", "b"]).collect()}
    assert got == {("overall", None): (3, 2), ("a", "x"): (2, 1), ("a", "y"): (1, 1), ("b", "p"): (1, 1), ("b", "q"): (1, 0), ("b", None): (1, 1)}
    blocks = {r.a: (r.n, r.accuracy) for r in aggregates.by_condition(df, ["x", "never"], "a").collect()}
    assert blocks == {"x": (2, 0.5), "never": (0, None)}


def test_savings_bases_differ(spark):
    df = spark.createDataFrame([(100, 40), (10, 9), (50, 25)], "plain int, compressed int")
    r = aggregates.token_savings(df, "plain", "compressed").first()
    assert (r.n_pairs, r.savings_sum, r.savings_median, r.savings_unit_mean) == (3, 53.75, 50.0, 40.0)


def test_frontier_ties_and_failures(spark):
    rows = [("s", 1, 9.0, 10.0), ("s", 2, 9.0, 10.0), ("s", 3, 2.0, 50.0), ("f", 1, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "style string, level int, score double, savings double").withColumn("base", F.lit(9.5))
    got = {r.style: (r.best_level, r.best_savings, r.all_failed_first) for r in aggregates.frontier(df, ["style"], "level", "score", "savings", "base").collect()}
    assert got == {"s": (1, 10.0, False), "f": (None, None, True)}


def test_taxonomy_counts_what_nobody_judged(spark):
    answers = spark.createDataFrame([(i,) for i in range(5)], "k int")
    judged = spark.createDataFrame([(0, "wrong"), (1, "unparsed"), (2, "grader_wrong")], "k int, verdict string")
    r = aggregates.taxonomy(joins.with_verdicts(answers, judged, ["k"]).withColumn("g", F.lit(1)), ["g"], "verdict", ["wrong", "grader_wrong"]).first()
    assert (r.n, r.n_wrong, r.n_grader_wrong, r.n_unparsed, r.n_unjudged, r.parse_rate) == (5, 1, 1, 1, 2, 0.666667)


def test_positional_types_and_deficits(spark):
    df = spark.createDataFrame([("t", [("fact",), ("odd",), (None,)])], "task string, items array<struct<kind:string>>")
    rows = dedupe.positional_types(df, "items", "kind", ["fact", "name"], ["fact", "name"]).orderBy("pos").collect()
    assert [(r.repaired_type, r.repaired) for r in rows] == [("fact", False), ("name", True), (None, True)]
    want = dedupe.deficits(spark.createDataFrame([("a", "x"), ("a", "x")], "g string, k string"), "g", "k", {"x": 2, "y": 1}, spark.createDataFrame([("a",), ("b",)], "g string"))
    assert {(r.g, r.k, r.have, r.want) for r in want.collect()} == {("a", "y", 0, 1), ("b", "x", 0, 2), ("b", "y", 0, 1)}


def test_lexical_keeps_ordinals(spark):
    assert spark.range(1).select(lexical(F.lit("3rd 1,000"))).first()[0] == "3rd 1 000"
