import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.operators import codec, mining
from quillspark.plans import dictionary

BOOK = [codec.Entry("ETA", "estimated time of arrival"), codec.Entry("ET", "estimated time"), codec.Entry("LONGCODE", "cat"), codec.Entry("OTW", "on the way")]


def test_encode_longest_first_and_economy():
    coded, applied, skipped = codec.Codebook(BOOK).encode("The estimated time of arrival, estimated time; Estimated Time; cat on the way")
    assert coded == "The ETA, ET; Estimated Time; cat OTW"
    assert [a[0] for a in applied] == ["ETA", "ET", "OTW"] and applied[0][2:] == (4, 29) and skipped == [("LONGCODE", "cat")]


def test_skipped_span_is_used_up():
    book = codec.Codebook([codec.Entry("ABCDEFGHIJKLMNOPQR", "red cat"), codec.Entry("CT", "cat sat")])
    assert book.encode("red cat sat")[0] == "red cat sat"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcot ,.XE", max_size=60))
def test_round_trip(text):
    book = codec.Codebook([codec.Entry("X1", "ab cot"), codec.Entry("X2", "to a"), codec.Entry("X3", "ab")])
    assert book.decode(book.encode(text)[0])[0] == text


def test_round_trip_of_texts_that_hold_codes(spark):
    """A code that the text had before comes back as it was."""
    texts = ["DEL LOS", "ETA ETA estimated time of arrival, ET; estimated time OTW on the way", "😀 on the way 😀 OTW", "", None]
    encode = codec.dictionary_encoder(BOOK)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", encode("t").alias("e")).select("t", "e.coded", codec.dictionary_restored(F.col("e")).alias("back")).collect()
    assert [r.back for r in rows] == [r.t for r in rows] and sum(r.coded != r.t for r in rows if r.t) == 2
    assert codec.restored_text("ET", [("ETA", "estimated time of arrival", 0)]) is None


def test_unknown_codes_are_findings():
    text, unknown = codec.Codebook(BOOK).decode("ETA of NASA is 12.")
    assert text == "estimated time of arrival of NASA is 12." and unknown == ["NASA", "12"]


def test_register():
    rules = codec.Rules(verb_words=("been",), derivations={"information": "info", "cat": "ct"})
    coded, dropped, derived = codec.encode_register("The cat is a blue pet, it was going; the information was", rules)
    assert coded == "The cat blue pet, it was going; info was"
    assert [(d[0], d[1]) for d in dropped] == [("is", "copula"), ("a", "article"), ("the", "article")] and [d[:2] for d in derived] == [("information", "info")]


def test_columns(spark):
    df = spark.createDataFrame([("estimated time of arrival is now",), (None,), ("",)], "t string")
    router = codec.router_encoder(BOOK, codec.Rules())
    rows = df.select(router(df.t).alias("p")).select("p.coded", "p.register.lossy", codec.loss_summary(F.col("p.register.dropped"), F.col("p.register.derived")).alias("loss")).collect()
    assert rows[0].coded == "ETA now" and rows[0].lossy and rows[1].coded is None and rows[2].coded == "" and "copulas dropped: 1" in rows[0].loss
    check = codec.verifier(BOOK, codec.Rules(), strict=True)
    got = spark.createDataFrame([("plain",), ("NASA",), ("cat",)], "t string")
    assert [r.status for r in got.select(check("t").alias("v")).select("v.status").collect()] == [0, 2, 1]


def test_router_takes_one_python_worker(spark):
    router = codec.router_encoder(BOOK, codec.Rules())
    df = spark.createDataFrame([("the cat is on the way",), (None,)], "t string").select(router(F.col("t")).alias("e"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    some, none = df.select("e.*").collect()
    assert (some.dictionary.coded, [a.code for a in some.dictionary.applied], some.dictionary.skipped[0].code, some.register.lossy) == ("the cat is OTW", ["OTW"], "LONGCODE", True)
    assert some.coded == some.register.coded == codec.encode_register("the cat is OTW", codec.Rules())[0] and none.coded is None and none.dictionary.applied is None and none.register.lossy is None


def test_cipher(spark):
    tables = codec.cipher_tables(5)
    assert all(a != b for a, b in zip(*tables, strict=True)) and sorted(tables[0]) == sorted(tables[1])
    df = spark.createDataFrame([("Hello, Wörld 42!",)], "t string")
    coded = df.select(codec.cipher_encode("t", tables).alias("c"))
    text = coded.first().c
    assert text[0].isupper() and text.endswith("!") and "ö" in text and coded.select(codec.cipher_decode("c", tables)).first()[0] == "Hello, Wörld 42!"


def test_invalid_codes():
    assert codec.invalid_codes(["a1", "a1"]) == ["'a1' is there twice"] and codec.invalid_codes(["za1", "za12"]) == ["'za1' begins 'za12'"] and codec.invalid_codes(["a-b"]) and not codec.invalid_codes(["za01", "zc1"])


def occurrences(text, pattern):
    return [m.start() for m in re.finditer(f"(?={re.escape(pattern)})", text)]


def test_scan_finds_all_overlaps(spark):
    texts = [(1, "ababab"), (2, ""), (3, None), (4, "xaba")]
    patterns = ["aba", "ab", "b"]
    got = {(r.id, r.pattern, r.start) for r in mining.scan(spark.createDataFrame(texts, "id int, t string"), "id", "t", patterns).collect()}
    assert got == {(i, k, s) for i, t in texts for k, p in enumerate(patterns) for s in occurrences(t or "", p)}
    assert mining.scan(spark.createDataFrame(texts, "id int, t string"), "id", "t", []).count() == 0


def test_selection():
    patterns = ["abcdefghijklmnop", "abcdefghijkl"]
    found = [(0, [(1, 3, [0]), (2, 3, [0])]), (1, [(1, 3, [0]), (2, 3, [0]), (3, 9, [0, 12]), (4, 1, [5, 7])])]
    chosen = mining.select(patterns, iter(found), 10, 100)
    assert [(c["segment"], c["code"], c["freq"]) for c in chosen] == [("abcdefghijklmnop", "zc01", 6), ("abcdefghijkl", "zc02", 10)]
    assert mining.select(patterns, iter(found), 10, 0) == []  # no test frames pay for a legend
    assert [mining.segment_code(i) for i in (1, 99, 100, 1098, 1099)] == ["zc01", "zc99", "zd001", "zd999", None]


def test_build_brings_every_frame_back(spark):
    rows = [(f"s{i % 4}", i, f'{{"kind":"move","user":{i % 3},"path":"/home/docs/{i % 5}"}}' if i % 4 else f"plain prefix of a log line {i}") for i in range(120)]
    df = spark.createDataFrame(rows, "session string, seq int, frame_text string")
    built = dictionary.build(df, "frame_text", "seq", test=500)
    assert built.chosen and not dictionary.failures(df, "frame_text", built).count()
    dictionary.check(df, "frame_text", built)
    assert dictionary.code_faults(built.codes()).count() == 0
    legend = built.legend_text().first()
    assert legend.segment_legend.startswith("=== segment legend ===\nzc01\t") and legend.frame_legend.count("\n") == built.frames.count() + 1
    whole = {r.text: r.code for r in built.frames.collect()}
    assert dictionary.failures(df, "frame_text", built, whole).count() == 0


def test_cli(capsys, tmp_path):
    path = tmp_path / "book.json"
    path.write_text('[{"name": "nav", "entries": [{"code": "ETA", "expansion": "estimated time of arrival"}]}]')
    assert cli.main(["encode", "the estimated time of arrival", "--codebook", str(path)]) == 0 and "the ETA" in capsys.readouterr().out
    assert cli.main(["decode", "ETA NASA", "--codebook", str(path), "--strict"]) == 2 and cli.main(["decode", "ETA", "--codebook", str(path)]) == 0
    assert cli.main(["verify", "plain text", "--codebook", str(path)]) == 0 and cli.main(["tables", "--codebook", str(path)]) == 0 and cli.main(["demo"]) == 0
    capsys.readouterr()
    cli.main(["cipher", "Abc 12"])
    coded = capsys.readouterr().out.strip()
    cli.main(["cipher", coded, "--decode"])
    assert capsys.readouterr().out.strip() == "Abc 12"
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
