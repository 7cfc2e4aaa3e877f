import random

import pytest

from quillspark.operators import codec, encoding


def rows_of(df):
    as_tuples = lambda x: None if x is None else [tuple(y) for y in x]
    return sorted(((r.i, r.e.coded, as_tuples(r.e.applied), as_tuples(r.e.skipped)) for r in df.select("i", "e").collect()), key=str)


def both(spark, texts, book):
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    entries = spark.createDataFrame(book, "code string, expansion string")
    want = docs.withColumn("e", codec.dictionary_encoder([codec.Entry(c, e) for c, e in book])("text"))
    return rows_of(encoding.dictionary_encoded(docs, entries, name="e")), rows_of(want)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_codec(spark, seed):
    rng = random.Random(seed)
    words = ["of", "The", "the", "end", "a", "été", "x_1", "information", "C", "AND"]
    phrases = {" ".join(rng.choices(words, k=rng.randint(1, 4))).strip() for _ in range(40)}
    unique = {p.casefold(): p for p in phrases}
    book = [(f"K{n}" if n % 3 else "LONGCODE" * 3, p) for n, p in enumerate(sorted(unique.values()))]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ". ", "\n", "-", ""]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    got, want = both(spark, [None, "", " ", "of the end", *texts, *texts[:30]], book)
    assert got == want


def test_entries_that_begin_or_end_with_signs(spark):
    book = [("A", "(the end)"), ("B", "the end"), ("C", ".NET core"), ("D", "C++ code"), ("E", "C++"), ("F", "two  blanks"), ("G", " padded phrase "), ("H", "x.NET")]
    texts = ["(the end)", "x(the end)y", "is .NET core.", "x.NET core", "C++ code", "C++code and C++ and C++.", "two  blanks two blanks", "a padded phrase b", "(THE END) the End"]
    got, want = both(spark, texts, book)
    assert got == want


def test_chains_of_overlaps(spark):
    """Each entry overlaps the next; the longest at a place wins, then what begins at its end or later."""
    names = [f"w{k}" for k in range(300)]
    book = [(f"P{k}", f"w{k} w{k + 1}") for k in range(299)] + [(f"Q{k}", f"w{k} w{k + 1} w{k + 2}") for k in range(0, 297, 7)]
    got, want = both(spark, [" ".join(names), " ".join(names[1:]), " ".join(names[5:80] + names)], book)
    assert got == want


def test_large_books_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(encoding, "BROADCAST_ENTRIES", 10)
    book = [(f"K{k}", f"the number{k} of them") for k in range(3000)]
    got, want = both(spark, [f"of the number{k} of them and the number{k + 1} of Them" for k in range(0, 3000, 50)], book)
    assert got == want and any(x[2] for x in got)


def test_empty(spark):
    got, want = both(spark, ["some text", None], [])
    assert got == want
    docs = spark.createDataFrame([], "i int, text string")
    assert encoding.dictionary_encoded(docs, spark.createDataFrame([("A", "b c d e")], "code string, expansion string")).collect() == []


@pytest.mark.parametrize("window", [1, 10, 243])
def test_long_entries_by_windows_and_by_texts(spark, monkeypatch, window):
    """Whether places take their tokens along or fetch them again, and no gram is stored as text."""
    stored, write = [], encoding.written
    monkeypatch.setattr(encoding, "written", lambda df, name: stored.append((name, df.columns)) or write(df, name))
    monkeypatch.setattr(encoding, "WINDOW", window)
    words = [f"w{k % 50}" for k in range(130)]
    book = [(f"L{n}", " ".join(words[k : k + n])) for k, n in ((0, 2), (0, 5), (3, 14), (3, 20), (10, 41), (10, 45), (60, 2), (60, 60))]
    texts = [" ".join(words), " ".join(words[3:]), "x " + " ".join(words[10:60]), " ".join(words[10:52]) + "y", "  ".join(words)]
    got, want = both(spark, texts, book)
    assert got == want and any("L45" == x[0] for r in got for x in r[2])
    assert not any("gram" in columns for _, columns in stored)


def test_openings_beyond_ascii(spark):
    book = [("S", "ΑΣ of Α"), ("T", "of the")]
    got, want = both(spark, ["ας of α ΑΣ of Α of the", "Of the of the"], book)
    assert got == want
