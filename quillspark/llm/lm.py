"""Cross-entropy difference scores from matched target and background bigram models over one vocabulary.

All words and pairs of the corpus are counted and used, however rare. Texts are tokenised once, into blocks of a
bounded number of tokens. A block sorts the hashed keys of its distinct words and pairs and hands them on with its
counts, cut into parts by ranges of keys; each part is summed over all blocks, and each block gets back, in the order
of its own keys, what the other blocks add. With that it scores its texts. So the tables grow with the corpus, no task
holds more than a part or a block, a common pair is one key of each block, and nothing is broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import fresh, grouped, loosened, packed, sized_join, slices, squeezed, trim, unpacked, written

_WORD = re.compile(r"\w+")
#: Words that the lower order counts for: pairs after a word, and each word of the vocabulary.
PRIOR_PAIRS, PRIOR_WORD = 8.0, 0.5
#: Tokens of a block, about; a longer text is a block of its own. Bytes of text whose keys make a part. Both have an
#: effect on memory and on what is shuffled only.
BLOCK_TOKENS, PART_BYTES = 1_000_000, 4_000_000
#: Bits of a key. Of 10^9 distinct words and pairs, one in 10^8 shares its key with another, and their counts add up.
#: The lowest bit says what a key stands for.
KEY_BITS = 56
WORD, PAIR = range(2)
#: Rows of a block: documents; numbers of their words, and these words; keys and counts by part.
DOCUMENTS, TOKENS, COUNTS = range(3)
#: The word that stands for the start of a text.
START = ""


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Numbers(dict):
    """A number for each new word, from 1; 0 is the start of a text."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _firsts(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The word before each token, 0 at the start of each text; texts lie one after another."""
    before = np.concatenate([[0], tokens[:-1]])[: len(tokens)]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    before[starts] = 0
    return before


def _hashes(words_: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 1) for w in words_], dtype=np.uint64)


def _keys(kind: int, hashes: np.ndarray) -> np.ndarray:
    return _mixed(hashes) >> np.uint64(64 - KEY_BITS) & ~np.uint64(1) | np.uint64(kind)


class Block(NamedTuple):
    """What the texts of a block, one after another, count: words and pairs."""

    tokens: np.ndarray  # numbers of words; 0 is the start of a text, which counts as a word here
    before: np.ndarray
    pairs: np.ndarray  # of each token: the place of its pair among the distinct ones
    lengths: np.ndarray
    size: int  # number of distinct words, the start included
    keys: np.ndarray  # of words, of pairs
    order: np.ndarray  # that sorts the keys

    @staticmethod
    def of(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> Block:
        """``hashes`` are those of the words, first that of a text's start."""
        before = _firsts(tokens, lengths)
        codes, pairs = np.unique(before << 32 | tokens, return_inverse=True)
        keys = np.concatenate([_keys(WORD, hashes), _keys(PAIR, _mixed(hashes[codes >> 32]) * np.uint64(3) + hashes[codes & 0xFFFFFFFF])])
        return Block(tokens, before, pairs.astype(np.int32), lengths, len(hashes), keys, np.argsort(keys))

    def counts(self, wanted: np.ndarray) -> np.ndarray:
        """How often each key stands in the texts that are wanted, and how often at the end of one."""
        each, some = np.repeat(wanted, self.lengths), self.lengths > 0
        words_ = np.bincount(self.tokens, weights=each, minlength=self.size)
        words_[0] = wanted[some].sum()
        last = np.bincount(self.tokens[(np.cumsum(self.lengths) - 1)[some]], weights=wanted[some], minlength=len(self.keys))
        pairs = np.bincount(self.pairs, weights=each, minlength=len(self.keys) - self.size)
        return np.stack([np.concatenate([words_, pairs]), last]).astype(np.int64)

    def by_token(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of counts by key: those of each token, of pairs after the word before it, and of their pair."""
        return counts[0][self.tokens], (counts[0] - counts[1])[self.before], counts[0][self.size + self.pairs]


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts of sorted keys begin and end."""
    lows = [(k << KEY_BITS) // parts for k in range(parts)]
    return np.append(np.searchsorted(keys, np.array(lows, dtype=np.uint64)), len(keys))


def blocks(flagged: DataFrame, id_col: str, text_col: str, target: str, parts: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of each block: a row a document (``id``, ``good``: in the target, ``n`` words), a row with the numbers of their words
    (``a``) and these words (``b``), and a row a part with its sorted keys (``a``: differences) and counts (``b``)."""
    kind = flagged.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        n_blocks, fields = 0, None
        numbers, texts, ids, good, total = _Numbers(), [], [], [], 0

        def rows(row: int, index: list[int], **columns: pa.Array) -> pa.RecordBatch:
            own = {"block": pa.array([part + n_blocks] * len(index), pa.int64()), "kind": pa.array([row] * len(index), pa.int32()), "i": pa.array(index, pa.int64())} | columns
            return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(index), f.type)) for f in fields], schema=fields)

        def flushed() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(x) for x in texts])
            yield rows(DOCUMENTS, list(range(len(texts))), id=pa.concat_arrays(ids), good=pa.array(good, pa.bool_()), n=pa.array(lengths, pa.int64()))
            tokens, names = np.concatenate(texts), [START, *numbers]
            # small numbers for frequent words take less room
            order = np.concatenate([[0], 1 + np.argsort(-np.bincount(tokens, minlength=len(names))[1:], kind="stable")])
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(len(order))
            tokens, names = number[tokens], [names[k] for k in order.tolist()]
            joined = squeezed("\n".join(names).encode("utf-8", "surrogatepass"))  # no word holds a line's end
            yield rows(TOKENS, [0], a=pa.array([packed(tokens)], pa.binary()), b=pa.array([joined], pa.binary()))
            block = Block.of(tokens, lengths, _hashes(names))
            keys = block.keys[block.order]
            counts = np.concatenate([block.counts(np.ones(len(texts))), block.counts(np.array(good, dtype=np.float64))])[:, block.order]
            cuts = _cuts(keys, parts)
            for p in range(0, parts, 100):
                index = [k for k in range(p, min(p + 100, parts)) if cuts[k] < cuts[k + 1]]
                own = [slice(cuts[k], cuts[k + 1]) for k in index]
                a = [packed(np.diff(keys[x], prepend=np.uint64(0)), 8) for x in own]
                yield rows(COUNTS, index, a=pa.array(a, pa.binary()), b=pa.array([packed(counts[:, x].ravel()) for x in own], pa.binary()))

        for batch in batches:
            for piece in slices(batch, 1):
                fields = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("i", pa.int64()), ("id", piece.schema.field(0).type), ("good", pa.bool_()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
                done = 0
                for k, (text, flag) in enumerate(zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True)):
                    w = words(text)
                    if total and total + len(w) > block_tokens:
                        ids.append(piece.column(0).slice(done, k - done))
                        yield from flushed()
                        n_blocks, done, total = n_blocks + 1, k, 0
                        numbers, texts, ids, good = _Numbers(), [], [], []
                    texts.append(np.fromiter(map(numbers.__getitem__, w), dtype=np.int32, count=len(w)))
                    good.append(bool(flag))
                    total += len(w)
                ids.append(piece.column(0).slice(done))
        if texts:
            yield from flushed()
        numbers, texts, ids, good = _Numbers(), [], [], []
        trim()

    schema = f"block bigint, kind int, i bigint, id {kind.simpleString()}, good boolean, n bigint, a binary, b binary"
    return flagged.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(target).alias("good")).mapInArrow(run, schema)


def summed(held: DataFrame) -> DataFrame:
    """For each part of each block, what the other blocks add to its counts (``a``), in the order of its keys; and of each
    part, once, the numbers of distinct words, of tokens, and of the target's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = _keys(WORD, _hashes([START]))[0]
        for table in grouped(batches, "i"):
            keys = [np.cumsum(unpacked(x, 8)) for x in table.column("a").to_pylist()]
            counts = [unpacked(x).reshape(4, -1) for x in table.column("b").to_pylist()]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.stack([np.bincount(at, weights=np.concatenate([x[k] for x in counts]), minlength=len(distinct)).astype(np.int64) for k in range(4)])
            word = (distinct & np.uint64(1) == WORD) & (distinct != start)
            more = [packed((total[:, x] - own).ravel(), 8) for x, own in zip(np.split(at, np.cumsum([len(x) for x in keys])[:-1]), counts, strict=True)]
            first = [[int(x)] + [0] * (len(keys) - 1) for x in (np.count_nonzero(word), total[0][word].sum(), total[2][word].sum())]
            columns = [table.column("block").combine_chunks(), table.column("i").combine_chunks(), pa.array(more, pa.binary()), *(pa.array(x, pa.int64()) for x in first)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "i", "a", "n_words", "n_all", "t_all"])
        trim()

    rows = held.where(F.col("kind") == COUNTS).select("i", "block", "a", "b").repartition("i").sortWithinPartitions("i", "block")
    return rows.mapInArrow(run, "block bigint, i bigint, a binary, n_words bigint, n_all bigint, t_all bigint")


def _own(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each token's place stands in the token's own document."""
    _, at, n = np.unique(doc * (int(place.max(initial=0)) + 1) + place, return_inverse=True, return_counts=True)
    return n[at].astype(np.float64)


def losses(block: Block, good: np.ndarray, n: np.ndarray, t: np.ndarray, totals: tuple[int, int, int]) -> np.ndarray:
    """Loss of each token under the target's and the background's model, in nats, in two columns.

    ``n`` and ``t`` are counts of the block's keys (see ``Block.counts``) in the corpus and in the target, ``totals`` the number of distinct words, of tokens, and of the
    target's tokens. Each document's own counts are taken out of both models.
    """
    size, n_all, t_all = totals
    doc = np.repeat(np.arange(len(block.lengths)), block.lengths)
    own = [_own(doc, x) for x in (block.tokens, block.before, block.pairs)]
    out = []
    for counts, inside, by, total in ((t, good[doc].astype(np.float64), 1.0, t_all), (n, np.ones(len(doc)), t_all / n_all if n_all else 0.0, n_all)):
        word, first, both = ((x - mine * inside) * by for x, mine in zip(block.by_token(counts), own, strict=True))
        rest = (total - block.lengths[doc] * inside) * by
        p = (word + PRIOR_WORD) / (rest + PRIOR_WORD * size)
        out.append(-np.log((both + PRIOR_PAIRS * p) / (first + PRIOR_PAIRS)))
    return np.array(out).T


def scores(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_tokens``, ``target_loss``, ``background_loss``, ``difference`` (means, nats).

    ``target_ids`` has the ids (``id_col``) of the target's documents; the background is the whole corpus. The models
    share their vocabulary (all words of the corpus) and priors, and the background's counts are scaled to the target's
    number of words, so a difference doesn't come from the target being the smaller corpus. Each is a distribution:
    (count of the pair + PRIOR_PAIRS * probability of the word) / (pairs after the first word + PRIOR_PAIRS). A document
    is scored by what the other documents say: its own counts are taken out of both models, else a document of the
    target would look like the target for its own rare words alone. Copies of it still count.

    A low difference means that a text is more like the target. A text without words has null losses and a null
    difference. Without a document in the target both models are the same and all differences are 0. Rows that repeat
    an id are documents of their own; rows with a null id are scored, and never belong to the target. Words and pairs
    are told apart by hashes of ``KEY_BITS`` bits. Texts aren't shuffled, but for the join that marks the target if it has more
    documents than ``sized_join`` broadcasts.
    """
    (flag,) = fresh(docs, "target")
    wanted = target_ids.select(id_col).where(F.col(id_col).isNotNull()).distinct().withColumn(flag, F.lit(True))
    parts = math.ceil((docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 1) / PART_BYTES)
    held = written(blocks(sized_join(docs.select(id_col, text_col), wanted, [id_col]), id_col, text_col, flag, parts, block_tokens), "blocks")
    more = written(summed(held), "sums")
    totals = tuple(int(x or 0) for x in more.agg(F.sum("n_words"), F.sum("n_all"), F.sum("t_all")).first())
    kind = docs.schema[id_col].dataType
    none = [F.lit(None).cast(t).alias(c) for c, t in (("id", kind), ("good", "boolean"), ("n", "bigint"))]
    given = more.select("block", F.lit(COUNTS).alias("kind"), "i", *none, "a", F.lit(None).cast("binary").alias("b"))
    rows = held.where(F.col("kind") != COUNTS).unionByName(given).repartition("block").sortWithinPartitions("block", "kind", "i")

    def scored(table: pa.Table) -> pa.RecordBatch:
        """A whole block; the order is by kind and number."""
        cuts = np.searchsorted(table.column("kind").to_numpy(), np.arange(4))
        documents, tokens, counts = (table.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False))
        lengths, good = documents.column("n").to_numpy(), documents.column("good").to_numpy().astype(np.float64)
        block = Block.of(unpacked(tokens.column("a")[0].as_py()), lengths, _hashes(loosened(tokens.column("b")[0].as_py()).decode("utf-8", "surrogatepass").split("\n")))
        added = [unpacked(x, 8).astype(np.int64).reshape(4, -1) for x in counts.column("a").to_pylist()]
        sums = []
        for k, wanted in ((0, np.ones(len(good))), (1, good)):
            sums.append(block.counts(wanted))
            sums[-1][:, block.order] += np.concatenate([x[2 * k : 2 * k + 2] for x in added], axis=1)
        loss = losses(block, good, *sums, totals)
        doc, none = np.repeat(np.arange(len(lengths)), lengths), lengths == 0
        means = [pa.array(np.bincount(doc, weights=loss[:, k], minlength=len(lengths)) / np.maximum(lengths, 1), mask=none) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(documents.column("id").chunks), pa.array(lengths), *means, pa.compute.subtract(*means)], names=[id_col, "n_tokens", "target_loss", "background_loss", "difference"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "block"):
            yield scored(table)
        trim()

    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_tokens bigint, target_loss double, background_loss double, difference double")
