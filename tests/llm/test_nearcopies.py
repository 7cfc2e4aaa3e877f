import random

import pytest

from quillspark.llm import nearcopies

WIDTH = nearcopies.WIDTH


def sets(texts):
    return {i: {tuple(w[k : k + WIDTH]) for k in range(len(w) - WIDTH + 1)} or {tuple(w)} for i, t in texts.items() for w in [t.split()]}


def wanted(texts):
    """What goes, and its keeper, by comparing all pairs."""
    of, root = sets(texts), {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if top(a) != top(b) and len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids if top(i) != i}


def found(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    return {r.doc_id: r.keeper for r in nearcopies.near_copies(df).collect()}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(0, len(words), WIDTH), n):
        words[at] = f"x{rng.randrange(10**9)}"
    return words


def text(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("block", [nearcopies.LEAST_BLOCK, 7])
def test_families_around_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "LEAST_BLOCK", block)
    # a member's nearest is often a look-alike just below 0.8, and what links it has gone by then
    rng, texts = random.Random(3), {}
    for f in range(40):
        base = text(rng, 300)
        for m in range(30):
            base = edited(rng, base, 2) if m % 2 else base
            texts[f * 100 + m] = " ".join(edited(rng, base, rng.randrange(1, 6)))
    want, got = wanted(texts), found(spark, texts)
    assert len(want) > 500 and not set(got) - set(want) and len(set(want) - set(got)) <= 0.005 * len(want)
    assert sum(got.get(i) != k for i, k in want.items()) <= 0.01 * len(want)


def test_pairs_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SMALL", 1)  # every bucket is a large one
    # five edits each, on lines over 13 points: any two texts share one place at most and are just below 0.8, but for twins
    rng = random.Random(4)
    base, texts = text(rng, 400), {}
    for k in range(169):
        words = list(base)
        places = [WIDTH * (1 + 13 * c + (k // 13 * c + k) % 13) for c in range(5)]
        for at in places:
            words[at] = f"x{rng.randrange(10**9)}"
        texts[2 * k] = " ".join(words)
        if k >= 120:
            words[places[0]] = f"twin{k}"
            texts[2 * k + 1] = " ".join(words)
    want, got = wanted(texts), found(spark, texts)
    assert want == {2 * k + 1: 2 * k for k in range(120, 169)} and got == want


def test_repeated_passages_and_few_shingles(spark):
    rng, texts = random.Random(5), {}
    for k in range(300):
        p, q, short = text(rng, 100), text(rng, 100), text(rng, 9)
        texts[10 * k], texts[10 * k + 1] = " ".join(p + q), " ".join(p * 10 + q)
        texts[10 * k + 2], texts[10 * k + 3] = " ".join(short[:8]), " ".join(short)
    want, got = wanted(texts), found(spark, texts)
    assert len(want) == 600 and got == want


def test_one_large_family_in_blocks(spark, monkeypatch):
    """A base with edits in ever more places: similarities from 0.2 to 1, so many members link to a few others only."""
    monkeypatch.setattr(nearcopies, "LEAST_BLOCK", 32)
    rng = random.Random(9)
    base = text(rng, 300)
    texts = {k: " ".join(edited(rng, base, rng.randrange(1, 12))) for k in range(400)}
    want, got = wanted(texts), found(spark, texts)
    assert 150 < len(want) < 399 and not set(got) - set(want) and len(set(want) - set(got)) <= 0.01 * len(want)
    assert sum(got.get(i) != k for i, k in want.items()) <= 0.01 * len(want)
