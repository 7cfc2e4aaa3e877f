import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    LINES = f.read()
RANKS = bpe.Ranks(LINES, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS.tokens, special_tokens={})

HARD = ["", " ", "a", "aaaaaaaaaaaa aaaaaaa", "  \n\n\t x", "😀é́ ١٢٣ ½", "abcabc" * 40, " " * 3000, "=-" * 1000, "\x1c\x85a\xa0b", "don't we'll I'D", "<|endoftext|>", "\x00\x01"]


def ids(texts):
    """By one replay over the distinct words of all texts."""
    found = [RANKS.pattern.findall(t) for t in texts]
    words = list(dict.fromkeys(w for x in found for w in x))
    flat, starts = RANKS.replay([w.encode() for w in words])
    of = {w: flat[starts[k] : starts[k + 1]].tolist() for k, w in enumerate(words)}
    return [[i for w in x for i in of[w]] for x in found]


def test_matches_the_library():
    assert ids(HARD) == [REFERENCE.encode_ordinary(t) for t in HARD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    got = ids(texts)
    assert got == [REFERENCE.encode_ordinary(t) for t in texts]
    assert [RANKS.decode(bpe.np.array(x, dtype=int)).decode() for x in got] == texts


@pytest.mark.parametrize("matches,part,replay", [(bpe.BLOCK_MATCHES, bpe.PART_BYTES, bpe.REPLAY_WORDS), (500, 9000, 40)])
def test_blocks_and_parts_do_not_matter(spark, sf_dir, monkeypatch, matches, part, replay):
    monkeypatch.setattr(bpe, "PART_BYTES", part)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(100).cache()
    hard = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    docs = docs.union(hard).repartition(3)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN, block_matches=matches).collect()}
    assert got == {r.doc_id: REFERENCE.encode_ordinary(r.text) for r in docs.collect()}


def test_a_word_is_replayed_once(spark):
    """However many blocks and documents hold it."""
    docs = spark.createDataFrame([(i, f"same words again number{i % 7}") for i in range(300)], "id bigint, text string").repartition(4)
    held = bpe.split(docs, public_tokenizers.PATTERN, 5, 50).cache()
    seen = spark.sparkContext.accumulator(0)
    lines = LINES

    def counting():
        ranks = bpe.Ranks(lines, public_tokenizers.PATTERN)
        replay = ranks.replay
        ranks.replay = lambda words: (seen.add(len(words)), replay(words))[1]
        return ranks

    assert held.where(f"kind = {bpe.DOCUMENTS}").count() == 300 and held.select("block").distinct().count() > 20
    assert bpe.replayed(held, counting).count() > 20
    assert seen.value == len({w for i in range(7) for w in RANKS.pattern.findall(f"same words again number{i}")})


def test_numbers_come_back():
    for top in (1, 191, 192, 193, 16_575, 16_576, 70_000, 5_000_000, 2**31 - 1):
        x = bpe.np.append(bpe.np.random.default_rng(top).integers(0, top, 2000), [0, top - 1, top])
        assert bpe._heard(bpe._told(x)).tolist() == x.tolist()
    assert len(bpe._heard(bpe._told(bpe.np.zeros(0, dtype=bpe.np.int64)))) == 0


def test_what_blocks_send_does_not_grow_with_the_parts(spark, sf_dir):
    """A thousand times the parts: as many rows and about as many bytes, in more groups of blocks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as id", "text").repartition(8)
    sent = []
    for parts in (6, 6000):
        rows = bpe.split(docs, public_tokenizers.PATTERN, parts, 20_000, 6).where(f"kind = {bpe.WORDS}").selectExpr("i", "octet_length(a) + octet_length(b) as n").collect()
        sent.append((len(rows), sum(r.n for r in rows), max(r.i for r in rows)))
    (rows, size, last), (more_rows, more_size, more_last) = sent
    assert last < 6 <= more_last and more_rows <= rows and more_size <= 1.02 * size


@pytest.mark.parametrize("most", [1, 3])
def test_groups_of_blocks(spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(bpe, "MOST_PARTS", most)
    monkeypatch.setattr(bpe, "PART_BYTES", 30_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN, block_matches=3000).collect()}
    assert got == {r.doc_id: REFERENCE.encode_ordinary(r.text or "") for r in docs.collect()}


def test_a_merge_of_lower_rank_goes_first():
    # merging "b"+"c" (rank 258) makes "a"+"bc" possible, which ranks before it: the word is done again, leftmost first
    tokens = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"xbc": 257, b"bc": 258}
    lines = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in tokens.items())
    ranks = bpe.Ranks(lines, r".+")
    reference = tiktoken.Encoding("low", pat_str=r".+", mergeable_ranks=tokens, special_tokens={})
    for text in ("abcbc", "bcabcxbc", "xbcbcabc"):
        got, starts = ranks.replay([text.encode(), b"bc"])
        assert got[: starts[1]].tolist() == reference.encode_ordinary(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "héllo wörld", "x"), (None, "a", "y"), (2, None, None), (2, "", "z")], "doc_id bigint, text string, ids string")
    rows = {(r.doc_id, r.n_tokens): r for r in bpe.encode(df, PATH, public_tokenizers.PATTERN).collect()}
    want = REFERENCE.encode_ordinary("héllo wörld")
    r = rows[1, len(want)]
    assert r.ids == want and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256("héllo wörld".encode()).hexdigest()
    assert rows[2, 0].ids_sha256 == hashlib.sha256(b"").hexdigest() and len(rows) == 3
    back = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert {r.text for r in back.collect()} == {"héllo wörld", "a", ""}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(df, PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [200_000])
def test_long_text(n):
    text = "ab cd" * n
    assert ids([text])[0] == REFERENCE.encode_ordinary(text)
