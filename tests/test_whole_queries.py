import hashlib

import pytest

from quillspark.operators import mining
from quillspark.plans import queries
from quillspark.plans.dictionary import build


def test_segment_select_considers_all_candidates(spark, sf_dir):
    got = {tuple(r) for r in queries.segment_select(spark, sf_dir).collect()}
    rows = queries.frames(spark, sf_dir)
    assert got == {tuple(r) for r in build(rows, "frame_text", "event_id", test=200).segments.collect()}
    assert len(got) > build(rows, "frame_text", "event_id", test=200, most_candidates=300).segments.count()


def test_score_answer_fuzzy_compares_whole_texts(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(100))
    rows = [(1, t, "assistant" if t % 2 else "user", text) for t in range(4)] + [(2, t, "user" if t % 2 else "assistant", text) for t in range(1, 5)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.verdict for r in queries.score_answer_fuzzy(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): "fuzzy", (1, 2): "fuzzy", (2, 1): "exact", (2, 3): "contains"}


def test_edges_are_those_of_whole_texts(spark, tmp_path):
    """Ends beyond the 4,000th character, which are frequent only together with a short text's, in the query, its SQL and the miner."""
    end = " and so it ends é"
    texts = [f"{i} {'z' * 5000}{end}" for i in range(4)] + [f"short{end}"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = {md5(end[-n:]): 5 for n in range(12, len(end) + 1)}
    got = {r.digest: r.freq for r in queries.prefix_suffix_candidates(spark, str(tmp_path)).collect()}
    assert got == want
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as con:
        con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
        assert dict(con.execute(queries.ORACLES["prefix_suffix_candidates"]).fetchall()) == want
    found = mining.candidates(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert {r.segment for r in found.collect()} == {end[-n:] for n in range(12, len(end) + 1)}
