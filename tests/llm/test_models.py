import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lm, quality, toxicity

SCHEMA = "doc_id bigint, text string, source string, lang string, target boolean, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, l, True, 1) for i, t, s, l in rows], SCHEMA)


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = i % 3 == 0
        w = [rng.choice(["alpha", "beta", "gamma"] if good and rng.random() < 0.6 else ["one", "two", "three", "four"]) for _ in range(rng.randrange(1, 60))]
        out.append((i, " ".join(w), f"s{i % 4}", "en"))
    return out


def plain_scores(rows, wanted):
    """The models by plain counting, each document without its own counts."""
    docs = [(i, lm.words(t), i in wanted) for i, t, *_ in rows]
    pairs = lambda w: list(zip(["<s>", *w[:-1]], w, strict=True)) if w else []
    n, t, pn, pt = Counter(), Counter(), Counter(), Counter()
    for _, w, good in docs:
        n.update(w)
        pn.update(pairs(w))
        t.update(w if good else [])
        pt.update(pairs(w) if good else [])
    scale = sum(t.values()) / sum(n.values())
    out = []
    for i, w, good in docs:
        means = []
        for single, double, by, own in ((t, pt, 1.0, good), (n, pn, scale, True)):
            one, two = single.copy(), double.copy()
            if own:
                one.subtract(w)
                two.subtract(pairs(w))
            mass = sum(one.values()) * by + lm.PRIOR_WORD * len(n)
            after = Counter()
            for (a, _), k in two.items():
                after[a] += k * by
            loss = [-math.log((two[a, b] * by + lm.PRIOR_PAIRS * (one[b] * by + lm.PRIOR_WORD) / mass) / (after[a] + lm.PRIOR_PAIRS)) for a, b in pairs(w)]
            means.append(np.mean(loss) if loss else None)
        out.append((i, len(w), *means))
    return out


@pytest.mark.parametrize("block_tokens", [lm.BLOCK_TOKENS, 50])
def test_lm_against_plain_counts(spark, block_tokens):
    """All counts, of the rarest words and pairs too: nulls, empty texts, repeated ids and rows, a very long text."""
    rare = [(700 + i, f"rare{i} rare{i + 1} pair once twice", "s", "en") for i in range(30)]
    rows = [*corpus(), *rare, (900, None, "s", "en"), (901, "unseen words here", "s", "en"), (902, "", None, None), (None, "alpha beta", "s", "en"), (901, "another text", "s", "en")]
    rows += [(903, "Ünïcode ÉTÉ 漢字 alpha", "s", "en"), (904, "long " * 3000 + "alpha beta " * 500, "s", "en"), (5, rows[5][1], "s5", "en")]
    wanted = {*range(0, 240, 3), 701, 904}
    ids = spark.createDataFrame([(i,) for i in [*wanted, 0, None]], "doc_id bigint")
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    got = sorted((tuple(r) for r in lm.scores(frame(spark, rows), ids, block_tokens=block_tokens).collect()), key=key)
    want = sorted(((i, n, a, b, None if a is None else a - b) for i, n, a, b in plain_scores(rows, wanted)), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(g[2:], w[2:], strict=True))
    by_id = {g[0]: g[4] for g in got}
    mean = lambda good: np.mean([by_id[i] for i in range(240) if (i % 3 == 0) == good])
    assert mean(True) < mean(False) - 0.2


def test_lm_without_target_and_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint")
    assert all(abs(r.difference) < 1e-12 for r in lm.scores(frame(spark, corpus(20)), none).collect())
    assert lm.scores(frame(spark, []), none).count() == 0
    assert [r.difference for r in lm.scores(frame(spark, [(1, None, "s", "en")]), none).collect()] == [None]


def test_lm_counts_every_word_and_pair(spark):
    """However rare, and in however many blocks and parts."""
    rows = [(i, f"w{i} v{i} u{i % 7}", "s", "en") for i in range(500)]
    held = lm.blocks(frame(spark, rows), "doc_id", "text", "target", 7, 100)
    assert held.where(f"kind = {lm.TOKENS}").count() > 10
    assert lm.summed(held).agg({"n_words": "sum", "n_all": "sum", "t_all": "sum"}).first().asDict() == {"sum(n_words)": 1007, "sum(n_all)": 1500, "sum(t_all)": 1500}


def test_lm_is_a_distribution():
    """Over all words after each word, whatever the document's own counts."""
    rng = np.random.default_rng(3)
    size = 6
    counts = rng.integers(0, 9, (size + 1, size + 1, 2)).astype(float)
    counts[:, 0] = 0
    counts[..., 1] = np.minimum(counts[..., 0], counts[..., 1])
    hashes = np.arange(1, size + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(1, size + 1):
        total = np.zeros(2)
        for b in range(1, size + 1):
            block = lm.Block.of(np.array([a, b]), np.array([2]), hashes)
            # the document is counted in, and taken out again
            own = counts.copy()
            own[0, a] += 1
            own[a, b] += 1
            words_, firsts = own.sum(axis=0), own.sum(axis=1)
            words_[0] = firsts[0]
            pairs = [own[p] for p in sorted({(0, a), (a, b)})]
            n, t = (np.array([[*words_[:, k], *(x[k] for x in pairs)], [*(words_ - firsts)[:, k], *[0] * len(pairs)]]) for k in (0, 1))
            loss = lm.losses(block, np.array([True]), n, t, (size, int(own[..., 0].sum()), int(own[..., 1].sum())))
            total += np.exp(-loss[1])
        assert np.allclose(total, 1)


def split(df, labels):
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)


@pytest.fixture(scope="module")
def held_out(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    return docs, *split(docs, labels)


def test_quality_held_out(held_out):
    docs, train, test = held_out
    rows = quality.scores(docs, train).join(test.withColumnRenamed("quality", "truth"), "doc_id").groupBy("truth").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.truth: r.kept for r in rows}
    assert kept[1] > 0.998 and kept[0] < 0.02
    ids = {r.doc_id for r in quality.kept(docs, train).select("doc_id").collect()}
    assert ids == {r.doc_id for r in quality.scores(docs, train).where("keep").select("doc_id").collect()}


def test_toxicity_held_out(held_out):
    docs, train, test = held_out
    clean = test.where("quality = 1")  # junk has replaced the toxic words of some others
    rows = toxicity.scores(docs, train).join(clean.withColumnRenamed("toxic", "truth"), "doc_id").groupBy("truth").agg(F.avg(F.col("toxic").cast("int")).alias("p"), F.avg("expected_severity").alias("s")).collect()
    by = {r.truth: r for r in rows}
    assert by[1].p > 0.95 and by[0].p < 0.005 and by[1].s > 1 > 0.1 > by[0].s


def test_quality_posteriors_by_hand(spark):
    scored = spark.createDataFrame([(f"h{i % 3}" if i % 5 else None, f"p{i % 2}", (-2.0 if i % 3 == 0 else 2.0) + 0.01 * i) for i in range(60)], "host string, path string, lo double")
    both, mean, m_host, m_path = quality.sites(scored, "host", "path", "lo")
    rows = quality.combined(scored, both, mean, m_host, m_path, "host", "path", "lo", ("a", "b", "c")).collect()
    p = [1 / (1 + math.exp(-r.lo)) for r in rows]
    assert abs(mean - sum(p) / 60) < 1e-9
    for r, own in zip(rows, p, strict=True):
        host = [q for x, q in zip(rows, p, strict=True) if (x.host or "") == (r.host or "")]
        path = [q for x, q in zip(rows, p, strict=True) if (x.host or "", x.path) == (r.host or "", r.path)]
        a = min(1 - quality.EDGE, max(quality.EDGE, (sum(host) - own + m_host * mean) / (len(host) - 1 + m_host)))
        b = min(1 - quality.EDGE, max(quality.EDGE, (sum(path) - own + m_path * a) / (len(path) - 1 + m_path)))
        shift = math.log(b / (1 - b)) - math.log(mean / (1 - mean))
        assert abs(r.a - a) < 1e-9 and abs(r.b - b) < 1e-9 and abs(r.c - 1 / (1 + math.exp(-(r.lo + shift)))) < 1e-9


def test_sparse_sites_shrink_more(spark):
    rows = [("big", "x", 3.0)] * 400 + [("bad", "x", -3.0)] * 400 + [("small", "x", -3.0)] * 2
    scored = spark.createDataFrame(rows, "host string, path string, lo double")
    found = {r.host: r.a for r in quality.combined(scored, *quality.sites(scored, "host", "path", "lo"), "host", "path", "lo", ("a", "b", "c")).collect()}
    assert found["bad"] < found["small"] < found["big"]


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "s", "en"), (2, "word " * 50_000, "s", "en"), (None, "plain text here", "s", None)]
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (None, 0, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    empty = labels.limit(0)
    for some in (labels, empty):
        assert quality.scores(frame(spark, rows), some).count() == 4 and toxicity.scores(frame(spark, rows), some).count() == 4
    assert quality.kept(frame(spark, rows), empty).count() == 4
    assert not toxicity.scores(frame(spark, rows), empty).where("toxic").count()
    assert quality.scores(frame(spark, []), labels).count() == toxicity.scores(frame(spark, []), labels).count() == quality.kept(frame(spark, []), labels).count() == 0
    assert quality.kept(frame(spark, rows), empty).columns == frame(spark, rows).columns


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(2)
    n, k = 3000, 12
    x = (rng.random((n, k)) < 0.3).astype(float)
    w = np.array([2.0, 1.0, -1.5] + [0.0] * (k - 3))
    latent = x @ w + rng.logistic(size=n)
    y = (latent > 0.5).astype(int) + (latent > 2.0)
    r, c = np.nonzero(x)
    got, theta = toxicity.fit(r, c, x[r, c], k, y, 3, penalty=1e-3)
    assert np.abs(got[:3] - w[:3]).max() < 0.35 and np.abs(got[3:]).max() < 0.2 and abs(theta[0] - 0.5) < 0.3 and abs(theta[1] - 2) < 0.4
    tails = 1 / (1 + np.exp(theta[None] - (x @ got)[:, None]))
    assert (tails[:, 0] >= tails[:, 1]).all()


def test_ordinal_fit_is_the_optimum():
    """No single weight or threshold can be moved to a better penalised likelihood, computed plainly."""
    rng = np.random.default_rng(5)
    x = rng.poisson(0.4, (400, 6)).astype(float)
    y = np.minimum(2, (x @ np.array([1.5, -1, 0.5, 0, 0, 0]) + rng.logistic(size=400) > 0.3).astype(int) + (x[:, 0] > 1))
    r, c = np.nonzero(x)
    w, theta = toxicity.fit(r, c, x[r, c], 6, y, 3, penalty=1e-2, rounds=3000)

    def cost(w, theta):
        total = 0.0
        for row, grade in zip(x, y, strict=True):
            upto = [0.0, *(1 / (1 + math.exp(-(t - float(row @ w)))) for t in theta), 1.0]
            total -= math.log(upto[grade + 1] - upto[grade])
        return total / len(y) + 1e-2 * np.abs(w).sum()

    best = cost(w, theta)
    for k in range(6):
        for step in (-0.05, 0.05):
            assert cost(w + step * np.eye(6)[k], theta) > best - 1e-5
    for k in range(2):
        for step in (-0.05, 0.05):
            assert cost(w, theta + step * np.eye(2)[k]) > best - 1e-5


def test_toxicity_grades_and_scores(spark):
    """Grades given by labels, told by their own words; scores of documents equal a plain sum over all features."""
    rng = random.Random(6)
    words = {0: ["calm", "plain", "sunny"], 1: ["rude", "grumbling"], 2: ["nasty", "insulting"], 3: ["vicious", "threatening"]}
    rows, grades = [], {}
    for i in range(800):
        grades[i] = rng.choice([0, 0, 0, 1, 2, 3])
        text = [rng.choice([*words[0], "the", "of", "some"]) for _ in range(30)] + [w for g in range(1, grades[i] + 1) for w in rng.choices(words[g], k=3)]
        rows.append((i, " ".join(text), "s", "en"))
    rows += [(5000, None, "s", "en"), (5001, "", "s", "en"), (5002, "vicious threatening rude nasty " * 5000, "s", "en"), (5003, "unseen", "s", "en")]
    labels = spark.createDataFrame([(i, g) for i, g in grades.items() if i % 2] + [(1, 0)], "doc_id bigint, toxic int")
    df = frame(spark, rows)
    got = {r.doc_id: r for r in toxicity.scores(df, labels).collect()}
    severity = [np.mean([got[i].expected_severity for i in grades if i % 2 == 0 and grades[i] == g]) for g in range(4)]
    assert all(a + 0.3 < b for a, b in zip(severity, severity[1:], strict=False))
    assert np.mean([got[i].grade == g for i, g in grades.items() if i % 2 == 0]) > 0.9
    model = toxicity.train(df, labels)
    for i, text, *_ in rows[::37] + rows[-4:]:
        s = model.score(text)
        tails = [1 / (1 + math.exp(min(40, max(-40, t - s)))) for t in model.thresholds]
        assert abs(got[i].expected_severity - sum(tails)) < 1e-9 and abs(got[i].p_toxic - tails[0]) < 1e-9 and got[i].grade == sum(t > 0.5 for t in tails)


def test_labelled_texts_without_features_count(spark):
    """They move the thresholds, however many there are, and a sample of nothing else is fitted as well."""
    told = [(i, f"plain words {'awful nasty' if i % 2 else 'good kind'} of text {i % 5}", i % 2) for i in range(60)]
    blank = [(100 + i, "" if i % 3 else None, 0) for i in range(300)]
    models = []
    for rows in (told, told + blank, [(i, "", i % 4 // 3) for i in range(40)]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
        models.append(toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic")))
    assert models[1].thresholds[0] > models[0].thresholds[0] + 1
    assert not models[2].weights and abs(1 / (1 + math.exp(models[2].thresholds[0])) - 0.25) < 0.02
