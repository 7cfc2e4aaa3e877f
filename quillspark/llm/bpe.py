"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words (matches of the split pattern) of the corpus are gathered: texts are split in blocks of a bounded
number of matches, a block hands on each of its distinct words once, and words are dealt out by their hash, so each
distinct word of the corpus is in one part (of a very large corpus, in one for each group of blocks). A part lays its words out as one flat linked list of byte tokens. An
inverted index holds, for each rank, the positions of the token pairs that merge to it. The merges are replayed in
rank order: each step takes the positions listed under the lowest rank left, merges them at once, and looks at nothing
but the pairs that touch a merged position. Merges in one word never depend on another word, so parts change nothing
but who does the work, and a word is encoded once, however many documents hold it. Blocks get the ids of their words
back in the order in which they sent them, and encode, decode and digest their texts.

Memory follows the sizes of a block and a part, nothing is collected, and what goes between tasks is compressed: words,
ids of words, and the numbers that stand for words in texts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import grouped, loosened, packed, slices, squeezed, trim, unpacked, written

#: Matches of the pattern in a block of texts, and distinct words whose merges are replayed together, about; bytes of text
#: whose words make a part. The only effect is on memory and on what is shuffled.
BLOCK_MATCHES, REPLAY_WORDS, PART_BYTES = 4_000_000, 150_000, 16_000_000
#: Parts that a block sends its words to, at most. Of more parts, blocks are gathered in groups with parts of their own, so
#: that what a block sends, and the rows in which it does, don't grow with the corpus; a word is then replayed once a group.
MOST_PARTS = 512
#: How hard words, their ids and the numbers that stand for them are compressed: all of what goes between tasks.
LEVEL = 9
#: Rows of a block: documents; numbers of the words in their texts; words, or their ids, by part.
DOCUMENTS, NUMBERS, WORDS = range(3)
#: Positions whose pairs are looked up at once.
CHUNK = 1 << 18


class Ranks:
    """A rank file (base64 token, rank), as arrays for the replay."""

    def __init__(self, lines: bytes, pattern: str):
        self.tokens: dict[bytes, int] = {}
        for line in lines.splitlines():
            if line:
                token, rank = line.split()
                self.tokens[base64.b64decode(token)] = int(rank)
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in self.tokens.items()}
        self.byte_ids = np.array([self.tokens[bytes([b])] for b in range(256)], dtype=np.int64)
        self.n = max(self.bytes_of) + 1
        pairs: dict[int, int] = {}
        for token, rank in self.tokens.items():
            for cut in range(1, len(token)):
                left, right = self.tokens.get(token[:cut]), self.tokens.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        # A two-level start: where the pairs of each left token begin, to keep the searches short.
        self.table_bits = 20
        self.slots, self.slot_keys, self.slot_ranks = self._hashed()
        sizes = np.zeros(self.n, dtype=np.int64)
        for rank, token in self.bytes_of.items():
            sizes[rank] = len(token)
        self.token_sizes = sizes
        self.token_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(self.n)), dtype=np.uint8)
        self.decimal = [str(i) for i in range(self.n)]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def _hashed(self):
        """Open addressing with linear probing; ``slots`` is the longest probe."""
        size = 1 << self.table_bits
        keys, ranks = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        left, where, longest = self.pair_keys, self._slot(self.pair_keys), 0
        value = self.pair_ranks
        while len(left):
            where = (where + (longest > 0)) % size
            free = keys[where] < 0
            first = np.zeros(len(where), dtype=bool)
            first[np.unique(where, return_index=True)[1]] = True
            put = free & first
            keys[where[put]], ranks[where[put]] = left[put], value[put]
            left, value, where = left[~put], value[~put], where[~put]
            longest += 1
        return longest, keys, ranks

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, -1 if none; a negative token is a word's edge."""
        keys = left.astype(np.int64) * self.n + right
        where = self._slot(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        mask = (1 << self.table_bits) - 1
        for _ in range(self.slots):
            if not len(open_):
                break
            at = where[open_]
            found = self.slot_keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_ranks[at[hit]]
            open_ = open_[~hit & (found >= 0)]
            where[open_] = (where[open_] + 1) & mask
        return out

    def greedy(self, word: bytes) -> list[int]:
        """One word, by repeatedly merging the leftmost pair of lowest rank."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min((self.tokens.get(a + b, self.n), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == self.n:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.tokens[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's ids start (one more entry at the end)."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1)  # each word is followed by an edge
        total = int(ends[-1]) if len(words) else 0
        sym = np.full(total + 1, -1, dtype=np.int32)
        sym[:total] = np.append(self.byte_ids, -1)[np.frombuffer(b"\n".join(words) + b"\n" * bool(words), dtype=np.uint8)]
        sym[ends - 1] = -1
        nxt = np.arange(1, total + 2, dtype=np.int32)
        prv = np.arange(-1, total, dtype=np.int32)
        ranks = np.full(total, -1, dtype=np.int32)
        for k in range(0, total, CHUNK):
            ranks[k : k + CHUNK] = self.rank(sym[k : k + CHUNK][: total - k], sym[k + 1 : k + 1 + CHUNK])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        redo: set[int] = set()

        def enter(positions: np.ndarray, of: np.ndarray) -> None:
            if len(positions) <= 12:
                for p, r in zip(positions.tolist(), of.tolist(), strict=True):
                    at = index.get(r)
                    if at is None:
                        index[r] = [[p]]
                        heapq.heappush(heap, r)
                    elif isinstance(at[-1], list):
                        at[-1].append(p)
                    else:
                        at.append([p])
                return
            order = np.argsort(of, kind="stable")
            positions, of = positions[order], of[order]
            cuts = np.flatnonzero(np.diff(of)) + 1
            for r, part in zip(of[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        live = np.flatnonzero(ranks >= 0).astype(np.int32)
        enter(live, ranks[live])
        del ranks, live
        while heap:
            r = heapq.heappop(heap)
            listed = index.pop(r)
            at = np.asarray(listed[0], dtype=np.int64) if len(listed) == 1 else np.concatenate([np.asarray(x, dtype=np.int64) for x in listed])
            right = nxt[at]
            # entries whose pair has changed since they were listed are stale
            ok = (sym[at] >= 0) & (self.rank(sym[at], sym[right]) == r)
            at = at[ok] if not ok.all() else at
            if len(listed) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            right = nxt[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # runs share a token: leftmost first
                kept, last = [], -1
                for p, q in zip(at.tolist(), right.tolist(), strict=True):
                    if p != last:
                        kept.append(p)
                        last = q
                at = np.array(kept, dtype=np.int64)
                right = nxt[at]
            after, before = nxt[right], prv[at]
            sym[at] = r
            sym[right] = -2
            nxt[at] = after
            prv[after] = at
            # a pair of two merged positions is seen from its left one
            left_rank = self.rank(np.where(before >= 0, sym[before], -1), sym[at])
            right_rank = self.rank(sym[at], sym[after])
            p = np.concatenate([before[left_rank >= 0].astype(np.int64), at[right_rank >= 0]])
            if len(p):
                q = np.concatenate([left_rank[left_rank >= 0], right_rank[right_rank >= 0]])
                if (q < r).any():  # such a merge would have to go before others of this rank in its word
                    redo.update(np.searchsorted(ends, p[q < r], side="right").tolist())
                enter(p, q)
        alive = sym[:total] >= 0
        ids = sym[:total][alive]
        counts = np.add.reduceat(alive, ends - lengths - 1, dtype=np.int64) if len(words) else np.zeros(0, dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        if redo:
            parts = np.split(ids, starts[1:-1])
            for w in redo:
                parts[w] = np.array(self.greedy(words[w]), dtype=np.int64)
            ids = np.concatenate(parts)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, starts

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.token_sizes[ids]
        if not len(ids):
            return b""
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.token_starts[ids] - (ends - sizes), sizes)
        return self.token_bytes[at].tobytes()


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


#: Numbers below this are a byte; the byte of a larger one says the middle of its bits, and its lower and upper bits go apart.
SHORT = 192


def _told(numbers: np.ndarray) -> bytes:
    """Small numbers, most of them very small, in few bytes."""
    over = numbers >= SHORT
    rest = numbers[over] - SHORT
    head = numbers.astype(np.uint8)
    head[over] = SHORT + (rest >> 8 & 63)
    parts = [squeezed(head.tobytes(), LEVEL), squeezed((rest & 255).astype(np.uint8).tobytes(), LEVEL), packed(rest >> 14, level=LEVEL)]
    return b"".join(len(x).to_bytes(5, "little") + x for x in parts)


def _heard(told: bytes) -> np.ndarray:
    parts = []
    while told:
        n = int.from_bytes(told[:5], "little")
        parts.append(told[5 : 5 + n])
        told = told[5 + n :]
    out = np.frombuffer(loosened(parts[0]), dtype=np.uint8).astype(np.int32)
    over = out >= SHORT
    low = np.frombuffer(loosened(parts[1]), dtype=np.uint8).astype(np.int32)
    out[over] += (out[over] - SHORT << 8) - (out[over] - SHORT) + low + (unpacked(parts[2]).astype(np.int32) << 14)
    return out


def _gathered(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a flat array that begin at ``starts``, in the order of ``which``, and their sizes."""
    begin, sizes = starts[which], starts[which + 1] - starts[which]
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)], sizes


def split(docs: DataFrame, pattern: str, parts: int, block_matches: int = BLOCK_MATCHES, most_parts: int = MOST_PARTS) -> DataFrame:
    """Rows of each block (``block, kind, i, id, n, a``): its documents (``id``, ``n`` matches), the numbers of the words in
    their texts (``a``, in order of the documents), and its distinct words by part (``a`` bytes, ``b`` lengths).

    Words are numbered by how often they stand in the block; ``c`` of the first row of numbers has their parts:
    within a part, words go in this order. Parts of group g of the blocks are numbered from g * ``most_parts``.
    """
    groups = math.ceil(parts / most_parts)
    parts = math.ceil(parts / groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, fields = regex.compile(pattern).findall, None
        part, n_blocks = TaskContext.get().partitionId() << 24, 0
        numbers, texts, ids, total = _Numbers(), [], [], 0

        def rows(row: int, index: list[int], **columns: pa.Array) -> pa.RecordBatch:
            own = {"block": pa.array([part + n_blocks] * len(index), pa.int64()), "kind": pa.array([row] * len(index), pa.int32()), "i": pa.array(index, pa.int64())} | columns
            return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(index), f.type)) for f in fields], schema=fields)

        def flushed() -> Iterator[pa.RecordBatch]:
            sizes = [len(x) for x in texts]
            yield rows(DOCUMENTS, list(range(len(texts))), id=pa.concat_arrays(ids), n=pa.array(sizes, pa.int64()))
            flat = np.concatenate(texts)
            order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(len(order))
            words = [w.encode("utf-8", "surrogatepass") for w in numbers]
            words = [words[k] for k in order.tolist()]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
            to = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            by_part = np.argsort(to, kind="stable")
            flat = number[flat]
            cuts = list(range(0, max(1, len(flat)), 1_000_000))
            c = pa.array([packed(to), *[None] * (len(cuts) - 1)], pa.binary())
            yield rows(NUMBERS, list(range(len(cuts))), a=pa.array([_told(flat[k : k + 1_000_000]) for k in cuts], pa.binary()), c=c)
            bounds = np.searchsorted(to[by_part], np.arange(parts + 1))
            for k in range(0, parts, 200):
                index = [p for p in range(k, min(k + 200, parts)) if bounds[p] < bounds[p + 1]]
                own = [[words[w] for w in by_part[bounds[p] : bounds[p + 1]].tolist()] for p in index]
                a = [squeezed(b"".join(x), LEVEL) for x in own]
                yield rows(WORDS, [(part >> 24) % groups * most_parts + p for p in index], a=pa.array(a, pa.binary()), b=pa.array([packed(np.array([len(w) for w in x])) for x in own], pa.binary()))

        for batch in batches:
            for piece in slices(batch, 1):
                fields = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("i", pa.int64()), ("id", piece.schema.field(0).type), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
                done = 0
                for k, text in enumerate(piece.column(1).to_pylist()):
                    found = find(text or "")
                    if total and total + len(found) > block_matches:
                        ids.append(piece.column(0).slice(done, k - done))
                        yield from flushed()
                        n_blocks, done, total = n_blocks + 1, k, 0
                        numbers, texts, ids = _Numbers(), [], []
                    texts.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found)))
                    total += len(found)
                ids.append(piece.column(0).slice(done))
        if texts:
            yield from flushed()
        numbers, texts, ids = _Numbers(), [], []
        trim()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"block bigint, kind int, i bigint, id {kind}, n bigint, a binary, b binary, c binary")


def replayed(held: DataFrame, ranks_of: Callable[[], Ranks], replay_words: int = REPLAY_WORDS) -> DataFrame:
    """``block, kind, i, a, b``: the ids of each block's words of a part, and their numbers, in the order of the words.

    All blocks' words of a part meet; each distinct one takes part in one replay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of()
        for table in grouped(batches, "i"):
            numbers, which = _Numbers(), []
            for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
                joined = loosened(a)
                ends = np.cumsum(unpacked(b)).tolist()
                own = [joined[x:y] for x, y in zip([0, *ends], ends, strict=False)]
                which.append(np.fromiter(map(numbers.__getitem__, own), dtype=np.int64, count=len(own)))
            words = list(numbers)
            flat, starts = [], [np.zeros(1, dtype=np.int64)]
            for k in range(0, len(words), replay_words):
                ids, at = ranks.replay(words[k : k + replay_words])
                flat.append(ids.astype(np.int32))
                starts.append(at[1:] + starts[-1][-1])
            flat, starts = np.concatenate(flat), np.concatenate(starts)
            out = [_gathered(flat, starts, x) for x in which]
            columns = [table.column(c).combine_chunks() for c in ("block", "kind", "i")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([packed(x[k], level=LEVEL) for x in out], pa.binary()) for k in (0, 1))], names=["block", "kind", "i", "a", "b"])
        trim()

    rows = held.where(F.col("kind") == WORDS).select("block", "kind", "i", "a", "b").repartition("i").sortWithinPartitions("i", "block")
    return rows.mapInArrow(run, "block bigint, kind int, i bigint, a binary, b binary")


_loaded: dict[str, Ranks] = {}


def _ranks(key: str, lines: bytes, pattern: str) -> Ranks:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Ranks(lines, pattern)
    return _loaded[key]


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, block_matches: int = BLOCK_MATCHES) -> DataFrame:
    """Encode every whole text, without special tokens, and decode the ids again.

    Returns one row per row of ``docs``: ``id_col``, ``n_tokens``, ``ids`` (with_ids: array of int), ``ids_sha256`` (of
    the decimal ids joined by one space) and ``decoded_sha256`` (of the decoded bytes). A null or empty text has no
    tokens and the digests of nothing. Null and repeated ids are kept as they are; other columns aren't read. An empty
    table gives an empty result. ``rank_file`` is read on the driver; its size is that of one vocabulary.
    """
    with open(rank_file, "rb") as f:
        lines = f.read()
    vocabulary = docs.sparkSession.sparkContext.broadcast(lines)
    key = hashlib.sha256(lines + pattern.encode()).hexdigest()
    ranks_of = lambda: _ranks(key, vocabulary.value, pattern)
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1) / PART_BYTES)
    held = written(split(texts, pattern, parts, block_matches, MOST_PARTS), "split")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("id", id_type), ("n", "bigint"))]
    given = replayed(held, ranks_of).select("block", "kind", "i", *nothing, "a", "b", F.lit(None).cast("binary").alias("c"))
    rows = held.where(F.col("kind") != WORDS).unionByName(given).repartition("block").sortWithinPartitions("block", "kind", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of()
        decimal = ranks.decimal.__getitem__
        for table in grouped(batches, "block"):
            cuts = np.searchsorted(table.column("kind").to_numpy(), np.arange(4))
            documents, numbers, words = (table.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False))
            sizes = [unpacked(x) for x in words.column("b").to_pylist()]
            starts = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int64)
            flat = np.concatenate([*[unpacked(x).astype(np.int32) for x in words.column("a").to_pylist()], np.zeros(0, np.int32)])
            to = unpacked(numbers.column("c")[0].as_py())
            place = np.empty(len(to), dtype=np.int64)
            place[np.argsort(to, kind="stable")] = np.arange(len(to))
            own = np.concatenate([_heard(x) for x in numbers.column("a").to_pylist()])
            ends = np.cumsum(documents.column("n").to_numpy())
            del sizes, table
            for k in range(0, documents.num_rows, 500):
                n, ids_list, digests, decoded = [], [], [], []
                part = documents.slice(k, 500)
                for x, y in zip([int(ends[k - 1]) if k else 0, *ends[k : k + 499].tolist()], ends[k : k + 500].tolist(), strict=False):
                    ids, _ = _gathered(flat, starts, place[own[x:y]])
                    n.append(len(ids))
                    digests.append(hashlib.sha256(" ".join(map(decimal, ids.tolist())).encode()).hexdigest())
                    decoded.append(hashlib.sha256(ranks.decode(ids)).hexdigest())
                    if with_ids:
                        ids_list.append(ids)
                out = {id_col: part.column("id").combine_chunks(), "n_tokens": pa.array(n, pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(ids_list, pa.list_(pa.int32()))
                out |= {"ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(out)
        trim()

    ids_type = "ids array<int>, " if with_ids else ""
    return rows.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, n_tokens bigint, {ids_type}ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id arrays: ``id_col``, ``text`` (bytes that aren't UTF-8 are replaced; a null array gives null)."""
    with open(rank_file, "rb") as f:
        lines = f.read()
    vocabulary = encoded.sparkSession.sparkContext.broadcast(lines)
    key = hashlib.sha256(lines + pattern.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(key, vocabulary.value, pattern)
        for batch in batches:
            texts = [None if x is None else ranks.decode(np.array(x, dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")
