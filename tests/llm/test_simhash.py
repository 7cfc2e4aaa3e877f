import random

import xxhash

from quillspark.llm import nearcopies, simhash
from quillspark.llm.graph import components


def plain_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_roots(ids, linked):
    root = {i: i for i in ids}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = sorted((of(a), of(b)))
        root[y] = x
    return {i: of(i) for i in ids}


def test_fingerprint():
    for t in (None, "", "  \n", "One", "one TWO", "ÄÖ é a b", "a b c d e f a b c", "x " * 1000, "a\x0bb\x0cc\rd"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int")


def test_clusters_against_brute_force(spark, sf_dir):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(3)
    rows = base + [(1000 + i, " ".join(w if rng.random() > 0.004 else "zz" for w in t.split(" "))) for i, t in base[:120]] + [(5000, None), (5001, ""), (5002, " ")]
    got = {r.doc_id: r for r in simhash.clusters(docs(spark, [(i, t, "x", 1) for i, t in rows])).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    roots = plain_roots(fps, linked)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", roots[i]) for i in fps}
    assert any(fps[a] != fps[b] for a, b in linked)


def test_ball_pairs_are_whole(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = {i: x - (1 << 64) * (x >> 63) for i, x in enumerate(sorted(fps))}
    df = spark.createDataFrame([(x, i) for i, x in signed.items()], "fp bigint, rep bigint")
    fp = dict(enumerate(sorted(fps)))
    found = {(r.a, r.b) for r in simhash.near_pairs(df).collect()}
    assert all((fp[a] ^ fp[b]).bit_count() <= 2 for a, b in found)
    truth = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    assert plain_roots(fp, found) == plain_roots(fp, truth)


def test_null_ids_repeats_and_empty(spark):
    got = simhash.clusters(docs(spark, [(3, "a b c", None, None), (3, "a b c", None, None), (None, "a b c", None, None), (None, "only one", None, None)])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in got if r.component_id) == [(False, 3, 3), (False, 3, 3), (True, None, 3)] and len(got) == 4
    assert simhash.clusters(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(150)] + [(7, 7)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, 4)], "a bigint, b bigint")
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.root for r in components(df).collect()} == plain_roots(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(df.limit(0)).count() == 0


def similarity(x, y, width=5):
    a, b = ({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)} for w in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b)


def test_near_copies_against_brute_force(spark, sf_dir):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text.split()) < 700]
    rng = random.Random(9)
    rows = list(base)
    for k in range(3):
        for i, t in base[:70]:
            w = t.split(" ")
            for _ in range(max(1, len(w) // 100)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            rows.append((10_000 * (k + 1) + i, " ".join(w)))
    rows += [(90_000, ""), (90_001, None), (90_002, "A  b"), (90_003, "a B\n")]
    gone = {r.doc_id: r.keeper for r in nearcopies.near_copies(docs(spark, [(i, t, None, 0) for i, t in rows])).collect()}
    by = {i: t or "" for i, t in rows}
    ids = sorted(by)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (min(len(by[a]), len(by[b])) >= 0.6 * max(len(by[a]), len(by[b])) and similarity(by[a], by[b]) >= 0.8)]
    roots = plain_roots(ids, linked)
    want = {i: r for i, r in roots.items() if i != r}
    missed, extra = set(want) - set(gone), set(gone) - set(want)
    assert not extra and len(missed) <= 0.01 * len(want) and len(want) > 150


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(400):
        w = list(words)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i + 1, " ".join(w), None, 0))
    rows.append((0, " ".join(words), None, 0))
    kept = nearcopies.deduplicated(docs(spark, [*rows, (None, "a b", None, 0)])).collect()
    assert [r.doc_id for r in kept if r.doc_id is not None] == [0] and len(kept) == 2
