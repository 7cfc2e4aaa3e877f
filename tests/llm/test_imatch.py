import collections
import hashlib
import re

from pyspark.sql import functions as F

from quillspark.llm import imatch


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, fingerprint string, pid int")


def plain_terms(t):
    return {x for x in re.split(r"[^\w]|_", (t or "").lower()) if x}


def edited(rows):
    """id, text, edited text and next text of each row, in descending order of ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = len(t) // 3
        out[i] = (t, t[: len(t) - e] + nxt[:e], nxt)
    return out


def test_edited_texts_and_likeness(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 30)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, "äöü😀" * 5), (9002, None), (9003, ""), (9004, "abc")]
    got = {r.doc_id: r for r in imatch.edited_pairs(frame(spark, rows)).collect()}
    want = edited(rows)
    assert len(got) == len(rows)
    words = collections.defaultdict(set)
    for r in imatch.lexicon(frame(spark, rows)).collect():
        words[r.h].add(r.sub)
    hashes = {}
    for r in spark.createDataFrame([(x,) for t, e, n in want.values() for x in plain_terms(t) | plain_terms(e)], "t string").distinct().select("t", imatch.term_hash(F.col("t")).alias("h")).collect():
        hashes[r.t] = r.h

    def kept(t):
        inside = sorted(h for x in plain_terms(t) if (h := hashes.get(x, 0)) in words and h)
        return [tuple(h for h in inside if i in words[h]) for i in range(len(imatch.RATES))]

    def like(a, b):
        x, y = kept(a), kept(b)
        n = sum(bool(p or q) for p, q in zip(x, y, strict=True))
        return sum(bool(p) and p == q for p, q in zip(x, y, strict=True)) / n if n else float(a.lower() == b.lower())

    for i, (t, e, n) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert abs(r.near_edited - like(t, e)) < 1e-9 and abs(r.near_next - like(t, n)) < 1e-9
    by_text = {}
    for i, (t, _, _) in want.items():
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.85 * len(got)


def test_document_frequencies_are_over_all_documents(spark):
    rows = [(i, f"common word{i % 3} own{i}") for i in range(12)]
    words = {r.h for r in imatch.lexicon(frame(spark, rows), rare=0.3, frequent=0.4, rates=(1.0,)).collect()} - {0}
    want = {r.h for r in spark.createDataFrame([("word0",), ("word1",), ("word2",)], "t string").select(imatch.term_hash(F.col("t")).alias("h")).collect()}
    assert words == want


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "zz"), (2, "x")]
    got = imatch.edited_pairs(frame(spark, rows)).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert imatch.edited_pairs(frame(spark, [])).count() == 0
    (alone,) = imatch.edited_pairs(frame(spark, [(5, "abcdef")])).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0


def test_many_rows_without_an_id(spark, monkeypatch):
    """They come last, by the hash of their text, in several ranges; very long texts among them."""
    monkeypatch.setattr(imatch, "RANGE_ROWS", 10)
    texts = [f"text {i} has words w{i % 4} v{i % 9}" for i in range(120)] + ["long " * 50_000 + "end"]
    rows = [(None, t) for t in texts] + [(i, f"known {i} and w{i % 4}") for i in range(30)]
    got = imatch.edited_pairs(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    tie = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = [t for _, t in sorted([r for r in rows if r[0] is not None], key=lambda r: -r[0])] + sorted(texts, key=lambda t: -tie[t])
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for t, n in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r.edited_sha256 for r in got) == want


def test_fingerprints(spark):
    rows = [(i, f"t{i % 5} t{i % 7} u{i}") for i in range(60)]
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(frame(spark, rows)).collect()}
    assert len(got) == 60 and imatch.fingerprints(frame(spark, [])).count() == 0
