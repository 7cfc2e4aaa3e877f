import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import fim


def plain(doc_id, text, pattern=".", seed="1", rate=90, first=20):
    text = text or ""
    units = re.findall(f"(?s)(?:{pattern}|.)", text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < first:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", "a", "ab", "\n\n", "<P> in it", "an <M", ">S< <S", "😀é日\r\n x", "line one\nline two", "😀" * 200, "long " * 30_000]
    texts += ["".join(rng.choice("ab é日😀\n<>PSM") for _ in range(rng.randint(0, 400))) for _ in range(120)]
    out = [(i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts[:30]] + [(3, "ab")] * 40 + [(None, "again")] * 40
    return out + [(1000 + k, "x" * n) for k, n in enumerate((fim.BLOCK - 1, fim.BLOCK, fim.BLOCK + 1, 2 * fim.BLOCK)) for _ in range(3)]


@pytest.mark.parametrize("pattern", [".", r"\S+\s*", "a|ab|é+", r"\n", "a{0,3}b"])
def test_brute_force(spark, rows, pattern):
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], "doc_id bigint, text string, output string, cut int")
    got = fim.transform(df, units=pattern)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=key) == sorted((plain(i, t, pattern) for i, t in rows), key=key)


@pytest.mark.parametrize("first", [0, 100])
def test_round_trip(spark, rows, first):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").where("doc_id is not null").dropDuplicates(["doc_id"])
    got = fim.transform(df, rate=100, suffix_first=first).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    want = {r.doc_id: r.text or "" for r in df.collect()}
    assert {r.doc_id: r.back for r in got.collect()} == want
    digests = {r.doc_id: r.restored_sha256 for r in fim.transform(df, rate=100, suffix_first=first, digests=True).collect()}
    assert digests == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_empty_and_text_ids(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id bigint, text string"), digests=True).collect() == []
    got = fim.transform(spark.createDataFrame([("a", "some text"), ("b", None)], "doc_id string, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [plain("a", "some text"), plain("b", None)]


def test_texts_move_once(spark, rows, tmp_path):
    """One exchange holds texts; what else is needed of them is made behind it."""
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    df = fim.transform(spark.read.parquet(str(tmp_path / "docs")), digests=True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
