import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import rules

_WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    t = text or ""
    w = _WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    hit = {i + k for i, g in enumerate(windows) if often[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if _WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    some = [" ".join(rng.choice(["a", "b", "é", "日本 x", "#|", "\n", "\x0b", " ", "\x1c", "end.\n"]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    return [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a", "x\nx\n x\nx ", "y z\r\ny z\r\n", "w" * 40_000, "p q r s t u " * 4000, *some]


def test_counts(texts):
    for chunk in (pa.array(texts, pa.string()), pa.array(["cut", *texts], pa.large_string())[1:], pa.array([None, ""], pa.string())):
        got = rules.counted(chunk)
        assert list(zip(*[got[c].tolist() for c in rules._COUNTS], strict=True)) == [plain(x) for x in chunk.to_pylist()]
    for t in texts:
        assert [int(x[0]) for x in rules.counted(pa.array([t], pa.string())).values()] == list(plain(t))


def expected_rate(hosts, mean, strength):
    return {h: (k + mean * strength) / (n + strength) for h, (n, k) in hosts.items()}


def test_hosts_are_shrunk(spark):
    good, bad = "these are quite ordinary words of a text that says something plain", "too short"
    rows = [("poor", bad)] * 70 + [("poor", good)] * 30 + [("fine", good)] * 300 + [("fine", bad)] * 6 + [("tiny", bad), (None, good), (None, good)]
    rows += [(f"h{k}", bad if i < k % 3 else good) for k in range(120) for i in range(20)]
    df = spark.createDataFrame([(i, s, t, True, "x") for i, (s, t) in enumerate(rows)], "doc_id bigint, source string, text string, kept boolean, host string")
    got = rules.judged(df).collect()
    host_failed = {rows[r.doc_id][0]: r.host_failed for r in got}
    assert host_failed["poor"] and not host_failed["fine"] and not host_failed[None]
    assert not host_failed["tiny"]  # its one failure says less than what is usual
    assert {r.doc_id for r in got if r.kept} == {i for i, (s, t) in enumerate(rows) if t == good and s != "poor"}
    hosts = rules.verdicts(rules.counts(df, "doc_id", "text", "source")).collect()
    counted = {r.host: (r.n, r.failed_base) for r in hosts}
    mean, strength = rules.prior(spark.createDataFrame([(n, k) for n, k in counted.values()], "n bigint, k bigint"), "k")
    n, k = sum(a for a, _ in counted.values()), sum(b for _, b in counted.values())
    assert mean == pytest.approx((k + 0.5) / (n + 1)) and 0.5 < strength < 100
    assert {r.host: r.rate_base for r in hosts} == pytest.approx(expected_rate(counted, mean, strength))


def test_empty_and_alike(spark):
    kind = "doc_id bigint, source string, text string"
    assert rules.judged(spark.createDataFrame([], kind)).collect() == []
    got = rules.judged(spark.createDataFrame([(None, None, None)] * 50 + [(1, "", "")], kind)).collect()
    assert len(got) == 51 and all(r.base_failed and not r.kept and r.n_words == 0 for r in got)


def test_one_host_with_most_rows_costs_a_row_a_task(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"), F.lit("some words of text").alias("text"))
    rows = rules.verdicts(rules.counts(df, "doc_id", "text", "source"))
    assert {r.host: r.n for r in rows.collect()}["hot"] == 1334
