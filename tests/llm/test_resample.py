import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import crc, resample

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text, order):
    w = _WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, order=1, buckets=10_000, percent=10, least=20, seed="2024"):
    features = [plain_features(t, order) for _, t in docs]
    s, t = Counter(), Counter()
    for _, f in features:
        s.update(x % buckets for x in f)
    for x in target:
        t.update(c % buckets for c in plain_features(x, order)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for (i, _), (w, f) in zip(docs, features, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(x % buckets) for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], (r[0] is not None, r[0])))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["The", "café", "x9", "日本", "of", "A_b", "long" * 30, "😀"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return [None, "", "...", "one", "x" * 50_000 + " end " * 3000, *some, *some[:20]]


def test_crc_algebra():
    rng = random.Random(1)
    a = [rng.randbytes(rng.randint(0, 70)) for _ in range(300)]
    b = [rng.randbytes(rng.randint(0, 300)) for _ in range(300)]
    own = lambda xs: np.array([zlib.crc32(x) for x in xs], dtype=np.uint32)
    got = crc.combined(own(a), own(b), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]
    data = b"".join(a)
    ends = np.cumsum([len(x) for x in a])
    assert crc.words(np.frombuffer(data, np.uint8), ends - [len(x) for x in a], ends).tolist() == [zlib.crc32(x) for x in a]


@pytest.mark.parametrize("order", [1, 2, 4])
def test_features_are_those_of_joined_strings(texts, order):
    for chunk in (pa.array(texts, pa.string()), pa.array(["cut", *texts], pa.large_string())[1:]):
        buckets, owners, n_words = resample.features(chunk, order, 1 << 31)
        for i, t in enumerate(texts):
            w, want = plain_features(t, order)
            assert n_words[i] == len(w) and sorted(buckets[owners == i].tolist()) == sorted(x % (1 << 31) for x in want)


@pytest.mark.parametrize(("order", "percent"), [(1, 10), (2, 35), (1, 100)])
def test_brute_force(spark, texts, order, percent):
    docs, target = [(None if i == 7 else i, t) for i, t in enumerate(texts)], ["The café of 日本", None, "x9 abc", ""]
    got = resample.resample(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, rank int"), spark.createDataFrame([(t,) for t in target], "text string"), order=order, percent=percent)
    assert collected(got) == plain_resample(docs, target, order, percent=percent)


def test_empty_tables(spark, texts):
    none, docs = spark.createDataFrame([], "doc_id bigint, text string"), [(1, "a b " * 20), (2, "c " * 30)]
    assert resample.resample(none, spark.createDataFrame([("x",)], "text string")).collect() == []
    assert collected(resample.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "text string"), percent=50)) == plain_resample(docs, [], percent=50)


def test_a_third_of_the_rows_alike(spark):
    """Ranks are 1..n whatever repeats, and equal rows are cut into several ranges."""
    docs = [(7, "same words " * 15)] * 400 + [(100 + i, f"other {i} words " * 10) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    got = resample.resample(df, spark.createDataFrame([("same",)], "text string"), percent=50)
    rows = got.collect()
    assert len(rows) == 1200 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 601))
    ranked = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in rows)[:600]
