import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lines, mixing, queries


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, gone int, s string")


def plain_lines(rows, sites=5):
    spread, first = defaultdict(set), {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                spread[x.strip(" ")].add(s)
                if i is not None:
                    first[x.strip(" ")] = min(first.get(x.strip(" "), i), i)
    out = []
    for i, t, s in rows:
        keep = None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(" ") or len(spread[x.strip(" ")]) < sites or x.strip(" ") not in first or i == first[x.strip(" ")])
        out.append((i, keep))
    return sorted(out, key=str)


def line_rows():
    rows = [(i, f"own {i}\n  shared by all \n\nshared by all\nshared by four {i % 4}", f"s{i % 7}") for i in range(40)]
    rows += [(100 + i, "four sites", f"s{i % 4}") for i in range(12)] + [(200 + i, "five sites", f"s{i % 5}") for i in range(12)]
    rows += [(300, None, "s1"), (301, "", "s2"), (None, "shared by all\nx", "s3"), (302, "shared by all", None), (100, "five sites\nkept", "s9")]
    return rows + [(400 + i, "null site", None if i == 4 else f"s{i}") for i in range(5)]


@pytest.mark.parametrize("known", [lines.KNOWN, 0])
def test_line_dedup(spark, monkeypatch, known):
    monkeypatch.setattr(lines, "KNOWN", known)
    rows = line_rows()
    got = lines.deduplicated(frame(spark, [(i, t, s, 1, "x") for i, t, s in rows]), counts=True)
    assert got.columns == ["doc_id", "text", "source", "gone", "s", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == plain_lines(rows)


@pytest.mark.parametrize("known", [lines.KNOWN, 0])
def test_rows_without_an_id_are_told_apart(spark, monkeypatch, known):
    """They are one document that comes last, but each loses its own lines; a very long one and many equal ones."""
    monkeypatch.setattr(lines, "KNOWN", known)
    rows = [(i, "common\nown", f"s{i}") for i in range(6)] + [(None, f"common\nleft {i % 3}\ncommon", f"s{i}") for i in range(40)]
    rows += [(None, "common\n" * 30_000 + "end", "s1")] + [(None, f"only here {i % 2}", f"t{i}") for i in range(20)]
    got = lines.deduplicated(frame(spark, [(i, t, s, 1, "x") for i, t, s in rows]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == plain_lines(rows)


def test_line_dedup_many_sites_by_sketch(spark):
    rows = [(i, f"everywhere\nmine {i}", f"site{i}") for i in range(300)]
    got = {r.doc_id: r.text for r in lines.deduplicated(frame(spark, [(i, t, s, 1, "x") for i, t, s in rows])).collect()}
    assert got[0] == "everywhere\nmine 0" and all(got[i] == f"mine {i}" for i in range(1, 300))


def test_line_dedup_empty(spark):
    assert lines.deduplicated(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_embeddings", "op7_mixing"])
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    rounded = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert rounded(tuple(r) for r in got.select(*columns).collect()) == rounded(con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall())


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = sum(sizes.values())
    while open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > 3 * sizes[s]}
        if not over:
            target |= {s: share * w[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def mix_rows():
    rows = [(i, "w " * (i % 23), f"s{i % 6}" if i % 6 else ("big" if i % 4 else None)) for i in range(400)]
    return rows + [(900, "a\x0bb\x1cc d e", "tiny"), (901, None, "none"), (902, "", "none"), (903, "x " * 9000, "long"), (5, "same id", "s5"), (None, "null id", "s5"), (None, "null id", "s5")]


def test_mix(spark):
    rows = mix_rows()
    got = mixing.mix(frame(spark, [(i, t, s, 1, "x") for i, t, s in rows])).join(frame(spark, [(i, t, s, 1, "x") for i, t, s in rows]).select("doc_id", "source").where("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id", "left").collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = plain_targets(sizes)
    assert len(got) == len(rows)
    by_target = defaultdict(lambda: [0, None])
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_target[round(r.target, 6), r.source_size][0] += r.taken
    want = defaultdict(int)
    for s, t in target.items():
        want[round(t, 6), sizes[s]] += int(t + 0.5)
    assert {k: v[0] for k, v in by_target.items()} == dict(want)
    again = mixing.mix(frame(spark, [(i, t, s, 1, "x") for i, t, s in rows]).repartition(7))
    assert sorted(map(str, again.collect())) == sorted(str(r) for r in mixing.mix(frame(spark, [(i, t, s, 1, "x") for i, t, s in rows])).collect())


def test_mixed_rows(spark):
    rows = mix_rows()
    df = frame(spark, [(i, t, s, 1, "x") for i, t, s in rows])
    got = mixing.mixed(df)
    assert got.columns == df.columns and set(got.distinct().collect()) <= set(df.collect())
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
        longest[s] = max(longest[s], words(t))
    for r in got.collect():
        taken[r.source] += words(r.text)
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1
    assert max(got.groupBy("doc_id", "text", "source").count().select(F.max("count")).first()) <= 6  # two equal rows, three epochs each


def test_mix_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0


def test_keys_are_plain_md5(spark):
    keys = spark.range(1).select(mixing._key(F.lit(17), F.lit("t"), "mix-1"), mixing._key(F.lit(None).cast("bigint"), F.lit("t"), "mix-1")).first()
    assert keys[0] == int(hashlib.md5(b"mix-1:17").hexdigest()[:15], 16)
    assert keys[1] == int(hashlib.md5(b"mix-1:text:" + hashlib.md5(b"t").hexdigest().encode()).hexdigest()[:15], 16)
