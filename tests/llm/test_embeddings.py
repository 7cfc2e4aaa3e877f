import math
import random

import numpy as np
import pytest

from quillspark.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep string"


def made(n=600, dim=32, seed=4, copies=200):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    near = x[rng.integers(0, n // 3, copies)] + rng.standard_normal((copies, dim)) * rng.choice([0.05, 0.1, 0.15], (copies, 1))
    return np.concatenate([x, near, x[:40], 3 * x[40:60]]).astype(np.float32)


def brute(rows, threshold=0.98):
    ok = [(i, np.array(v, dtype=float), l) for i, v, l in rows if l is not None and i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = {i: 0 for i, *_ in rows}
    root = {i: i for i, *_ in rows if i is not None}
    for k, (i, v, l) in enumerate(ok):
        for j, w, m in ok[k + 1 :]:
            if l == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    for i in root:
        while root[root[i]] != root[i]:
            root[i] = root[root[i]]
    return links, root


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.clusters(df, **options).collect()}
    links, root = brute(rows)
    assert got == {i: (links[i], root.get(i), None if i is None else root[i] == i) for i in links}
    return links


def test_against_brute_force(spark):
    x = made()
    rng = random.Random(1)
    rows = [(i * 3, v.tolist(), rng.randrange(2)) for i, v in enumerate(x)]
    links = check(spark, rows)
    assert sum(links.values()) > 50


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [float("nan"), 1.0, 1.0], 1), (7, [None, 1.0, 1.0], 1), (8, [float("inf"), 1.0, 1.0], 1), (9, [], 1), (10, [1.0, 2.0], 1), (11, [2.0, 4.0, 6.0], 1), (12, v, 2), (13, [1e-30, 2e-30, 3e-30], 1), (None, [9.0, 0.0, 0.0], 1)]
    check(spark, rows)


def test_hot_buckets_are_split(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(24)
    rows = [(i, (centre + 0.02 * rng.standard_normal(24)).astype(np.float32).tolist(), 0) for i in range(300)]
    links = check(spark, rows, block_rows=40)
    assert links[0] == 299


def test_empty(spark):
    assert embeddings.clusters(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dim", [64, 100, 24, 7])
def test_estimates_bound_the_cosine(dim):
    rng = np.random.default_rng(3)
    u = embeddings.unit(rng.standard_normal((2000, dim)))
    v = embeddings.unit(u + 0.3 * rng.standard_normal((2000, dim)) / dim**0.5)
    codes = embeddings.Codes(dim, 10, 20)
    packed = codes.encode(np.concatenate([u, v]), embeddings.SEED)
    assert packed.shape == (4000, codes.width) and codes.width < 4 * dim or dim < 64
    codes.read(packed)
    i, j = np.arange(2000), np.arange(2000, 4000)
    true = (u * v).sum(axis=1)
    assert (codes.bounds(i, j, 5.0) >= true).mean() > 0.999
    assert abs((codes.estimates(i, j) - true).mean()) < 0.01 and abs((codes.estimates(j, i) - true).mean()) < 0.01  # unbiased
    apart = codes.estimates(i, np.roll(j, 1)) - (u * np.roll(v, 1, axis=0)).sum(axis=1)
    assert abs(apart.mean()) < 0.02
    if dim >= 64:
        assert (codes.bounds(i, np.roll(j, 1), 5.0) >= 0.98).mean() < 0.01  # what isn't near is ruled out


def test_few_cosines_are_computed_exactly(spark):
    x = made(3000, 64, 5, 300)
    df = spark.createDataFrame([(i, 0, v.tolist(), 1) for i, v in enumerate(x)], "rep bigint, grp bigint, vec array<float>, mult bigint")
    part = embeddings.links(df, 0.98).toPandas()
    u = embeddings.unit(x.astype(float))
    linked = int((np.triu(u @ u.T, 1) >= 0.98).sum())
    assert part["links"].sum() == 2 * linked
    assert linked <= part["n_exact"].sum() < 2 * linked + 1000  # of 5 million pairs


def test_plan_keeps_the_chance_of_a_miss():
    for n in (1, 50, 10**4, 10**9):
        bits, tables = embeddings.plan(n, 0.98, 1e-6)
        agree = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - agree) ** tables <= 1e-6
