"""Near copies by shingle similarity: ball hashing over several short SimHashes, then exact verification.

Two texts at the least similarity differ in each bit with probability ``flip``. A text has ``tables`` short
fingerprints of ``bits`` bits; each emits all variants one bit away (half of the radius 2), so texts meet if one of
their short fingerprints differs in two bits at most. ``bits`` follows the logarithm of the number of texts, which
keeps the buckets short at any size, and ``tables`` follows from the share ``miss`` of pairs, at the very threshold, that
may never meet or be ruled out by the ``QUICK`` bits; more similar ones meet all but surely.

Votes are over distinct shingles, as the similarity is. Bits of few shingles don't follow ``flip``; such texts meet by
their least shingle hashes instead: of two sets that share enough, the least few of each share one (prefix filter).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import discard, grouped, own_columns, sized_join, slices, text_or_empty, trim, written
from quillspark.llm.graph import EDGES, components, contracted, stars
from quillspark.llm.simhash import CHUNK, SEED

WIDTH, SIMILARITY, MISS = 5, 0.8, 0.004
#: Bits by which texts of one bucket are compared, and standard deviations that they may differ by beyond the expected.
QUICK, SLACK = 128, 3.5
#: The first search goes through buckets of more texts leader by leader rather than pair by pair.
SMALL = 64
#: Texts of at most so many distinct shingles meet each other by shingles, exactly. Of those, a bit differs with at most
#: this chance (4 of 5 shingles shared; 0.15 for many).
FEW, FEW_FLIP = 64, 0.1875
#: Texts of a cluster of candidates that are compared in one piece, at least and at most; larger clusters are cut into
#: blocks, of about a ``SPREAD``-th, whose pairs are dealt out to different tasks. A block has so many bytes of text at most.
LEAST_BLOCK, MOST_BLOCK, SPREAD, BLOCK_BYTES = 128, 1024, 64, 16_000_000


def flip(similarity: float) -> float:
    """Chance that a bit differs between texts of a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_away(p: float) -> int:
    """Most of the ``QUICK`` bits that texts may differ in which differ in each with chance ``p``."""
    return math.floor(QUICK * p + SLACK * math.sqrt(QUICK * p * (1 - p)))


def ruled_out(p: float) -> float:
    """Share of such texts that differ in more."""
    return 1 - sum(math.comb(QUICK, k) * p**k * (1 - p) ** (QUICK - k) for k in range(most_away(p) + 1))


def plan(n: int, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[int, int]:
    """``bits`` of a short fingerprint, and ``tables``: never meeting and being ruled out make up ``miss`` at most."""
    bits = min(38, max(12, math.ceil(math.log2(max(n, 1))) + 1))
    p = flip(similarity)
    meet = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    left = max(miss - ruled_out(p), miss / 10)
    return bits, max(1, math.ceil(math.log(left) / math.log(1 - meet)))


def prefix(h: np.ndarray, similarity: float) -> np.ndarray:
    """The least of distinct shingle hashes, so many that sets of the similarity share one of them; as negative keys."""
    least = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
    return (h[:least] | np.uint64(1 << 63)).view(np.int64)


def shingles(text: str | None, width: int) -> tuple[bytes, np.ndarray]:
    """Words joined by one space (A-Z lower-cased), and the XXH64 of each shingle; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return joined, np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], dtype="<u8")
    begins, at = [0], 0
    for w in words:
        at += len(w) + 1
        begins.append(at)
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    return joined, np.fromiter((digest(joined[i : j - 1], SEED) for i, j in zip(begins, begins[width:], strict=False)), dtype="<u8", count=n)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def signature(h: np.ndarray, n_words: int) -> np.ndarray:
    """``n_words`` * 64 bits: the majority of the bits of as many independent hashes of the shingles."""
    out = np.zeros(n_words * 64, dtype=bool)
    for k in range(n_words):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), CHUNK):
            part = np.ascontiguousarray(_mixed(h[at : at + CHUNK], k))
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k * 64 : (k + 1) * 64] = 2 * ones > len(h)
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int, tables: int, similarity: float) -> DataFrame:
    """``id, k1, k2`` (128 bits of the words), ``s0, s1`` (bits to compare by), ``words`` and ``least`` (for the buckets)."""
    n_words = QUICK // 64 + math.ceil(bits * tables / 64)
    powers = (1 << np.arange(bits)).astype(np.int64)
    none = np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                k1, k2, sigs, words, least = [], [], [], [], []
                for t in part.column(1).to_pylist():
                    joined, h = shingles(t, width)
                    k1.append(xxhash.xxh64_intdigest(joined, 1))
                    k2.append(xxhash.xxh64_intdigest(joined, 2))
                    h = np.unique(h)
                    many = len(h) > FEW
                    sig = signature(h, n_words if many else QUICK // 64)
                    sigs.append(np.packbits(sig[:QUICK]).view(np.int64))
                    words.append(sig[QUICK : QUICK + bits * tables].reshape(tables, bits) @ powers if many else none)
                    # the partner of a text of few shingles may have more
                    least.append(prefix(h, similarity) if len(h) * similarity <= FEW else none)
                keys = [pa.array(np.array(k, dtype=np.uint64).view(np.int64)) for k in (k1, k2)]
                s = np.array(sigs).reshape(-1, 2)
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (words, least)]
                yield pa.RecordBatch.from_arrays([part.column(0), *keys, pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), *lists], names=["id", "k1", "k2", "s0", "s1", "words", "least"])
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, k1 bigint, k2 bigint, s0 bigint, s1 bigint, words array<bigint>, least array<bigint>")


def _candidates(nodes: DataFrame, bits: int, similarity: float, how: str) -> DataFrame:
    """Of ``rep``s that meet, have other ``label``s and aren't ruled out by their bits, by ``how``:

    - nearest: a row for each that has a partner or is in a large bucket: ``a``, and as ``b`` the nearest of those before
      it (null if all come after). A large bucket is searched by leaders: those texts, by id, that aren't near one before.
    - open: edges ``a``, ``b`` that connect what the pairs of texts with other ``label``s connect, a few for each text.
    """
    most, most_few = most_away(flip(similarity)), most_away(max(FEW_FLIP, flip(similarity)))
    balls = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.when(k < bits, F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint")))
    near = F.flatten(F.transform("words", lambda w, t: F.transform(balls, lambda f: F.call_function("shiftleft", t.cast("bigint"), F.lit(bits)) + w.bitwiseXOR(f))))
    labels = [] if how == "nearest" else ["label"]
    rows = nodes.select("rep", "s0", "s1", *labels, F.explode(F.concat(near, "least")).alias("bucket"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", *labels, "rep")

    def apart(sigs: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(sigs[x] ^ sigs[y]).sum(axis=1, dtype=np.int32)

    def led(reps: np.ndarray, sigs: np.ndarray, begin: int, size: int, limit: int) -> Iterator[tuple[np.ndarray, ...]]:
        left = np.arange(begin, begin + size)
        while len(left):
            away = apart(sigs, left[1:], left[:1])
            near = away <= limit
            yield reps[left[1:][near]], np.full(int(near.sum()), reps[left[0]]), away[near]
            left = left[1:][~near]

    def across(labels: np.ndarray, begin: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a bucket, sorted by label, between labels; the largest label is never compared with itself."""
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(labels[begin : begin + size])) + 1, [size]])
        runs = [np.arange(begin + x, begin + y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        runs.sort(key=len)
        order = np.concatenate(runs)
        ends = np.repeat(np.cumsum([len(r) for r in runs]), [len(r) for r in runs])
        at, last = 0, len(order) - len(runs[-1])
        while at < last:
            # whole rows of the triangle, about a million pairs at once
            n = max(1, min(last - at, 1_000_000 // size))
            later = size - ends[at : at + n]
            i = np.repeat(np.arange(at, at + n), later)
            j = np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later) + np.repeat(ends[at : at + n], later)
            yield order[i], order[j]
            at += n

    def bucket_pairs(bucket: np.ndarray, reps: np.ndarray, labels: np.ndarray | None, sigs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(bucket)]]))
        limits = np.where(bucket < 0, most_few, most)
        small = (sizes > 1) & (sizes <= SMALL)
        s, n = starts[small], sizes[small]

        def kept(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
            if labels is not None:
                other = labels[x] != labels[y]
                x, y = x[other], y[other]
            away = apart(sigs, x, y)
            near = away <= limits[x]
            x, y = reps[x[near]], reps[y[near]]
            return np.maximum(x, y), np.minimum(x, y), away[near]

        for at in range(0, len(s), 20_000):
            i, j = _pairs(s[at : at + 20_000], n[at : at + 20_000])
            for k in range(0, len(i), 1_000_000):
                yield kept(i[k : k + 1_000_000], j[k : k + 1_000_000])
        for begin, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            if labels is None:
                yield from led(reps, sigs, begin, size, int(limits[begin]))
            else:
                for x, y in across(labels, begin, size):
                    yield kept(x, y)

    def nearest(a: np.ndarray, b: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((b, away, a))
        a, b, away = a[order], b[order], away[order]
        first = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
        return a[first], b[first], away[first]

    def batch_of(*columns: np.ndarray | pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    def flushed(held: list[pa.RecordBatch], edges: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        bucket, reps, s0, s1 = (table.column(c).to_numpy() for c in ("bucket", "rep", "s0", "s1"))
        labels = table.column("label").to_numpy() if how != "nearest" else None
        sigs = np.stack([s0, s1], axis=1).view(np.uint64)
        found = bucket_pairs(bucket, reps, labels, sigs)
        if how == "nearest":
            own = list(found)
            if own:
                a, b, away = (np.concatenate(x) for x in zip(*own, strict=True))
                _, at, n = np.unique(bucket, return_inverse=True, return_counts=True)
                other = np.setdiff1d(np.concatenate([b, reps[n[at] > SMALL]]), a)
                yield batch_of(*nearest(a, b, away))
                yield batch_of(other, pa.nulls(len(other), pa.int64()), pa.nulls(len(other), pa.int32()))
            return
        total = sum(len(x) for x, _ in edges)
        for a, b, _ in found:
            edges.append((a, b))
            total += len(a)
            if total > EDGES:
                edges[:] = [stars(edges)]
                total = len(edges[0][0])

    names = {"nearest": ["a", "b", "away"], "open": ["a", "b"]}[how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            own = batch.column("bucket").to_numpy()
            cut = int(np.searchsorted(own, own[-1])) if len(own) else 0
            if cut:
                held.append(batch.slice(0, cut))
                yield from flushed(held, edges)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flushed(held, edges)
        if edges:
            yield batch_of(*stars(edges))
        held = edges = []
        trim()

    found = rows.select("bucket", "rep", "s0", "s1", *labels).mapInArrow(run, ", ".join(f"{c} {'int' if c == 'away' else 'bigint'}" for c in names))
    if how == "open":
        return found
    return found.groupBy("a").agg(F.min(F.when(F.col("b").isNotNull(), F.struct("away", "b"))).alias("near")).select("a", "near.b")


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    later = sizes[each] - within - 1
    i = np.repeat(starts[each] + within, later)
    return i, i + 1 + np.arange(int(later.sum())) - np.repeat(np.cumsum(later) - later, later)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles have at least the similarity (Jaccard), by their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = functools.lru_cache(64)(lambda text: np.unique(shingles(text, width)[1]))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = of(x), of(y)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    rows = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _compared(clusters: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` that connect the texts of a cluster that have at least the similarity (Jaccard), by whole texts.

    Of ``cluster, rep, label, s0, s1, text``. All pairs with other labels are examined that their bits don't rule out,
    but for those that what was found before in the same block connects. Blocks are bounded by rows and bytes: a text
    is sent to as many tasks as its cluster has blocks, and no pairs are.
    """
    most, most_few = most_away(flip(similarity)), most_away(max(FEW_FLIP, flip(similarity)))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.col("n") / SPREAD))
    sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks")).where("blocks > 1")
    rows = sized_join(clusters, written(sizes, "blocks"), ["cluster"]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("lo"), F.greatest("block", k).alias("hi")))
    rows = rows.withColumn("meet", F.explode(meets)).withColumn("bucket", F.xxhash64("cluster", "meet"))
    rows = rows.select("bucket", "rep", "label", "s0", "s1", "block", (F.col("meet.lo") != F.col("meet.hi")).alias("across"), "text").repartition("bucket").sortWithinPartitions("bucket")

    def linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        reps, labels, s0, s1, block = (table.column(c).to_numpy() for c in ("rep", "label", "s0", "s1", "block"))
        across = bool(table.column("across")[0].as_py())
        sigs = np.stack([s0, s1], axis=1).view(np.uint64)
        sets = [np.unique(shingles(t, width)[1]) for t in table.column("text").to_pylist()]
        size = np.array([len(x) for x in sets])
        limit = np.where(size * similarity <= FEW, most_few, most)
        _, group = np.unique(labels, return_inverse=True)
        found: list[tuple[int, int]] = []
        for i in range(len(reps) - 1):
            j = np.arange(i + 1, len(reps))
            j = j[(group[j] != group[i]) & (block[j] != block[i] if across else True)]
            away = np.bitwise_count(sigs[j] ^ sigs[i]).sum(axis=1, dtype=np.int32)
            # sets whose sizes differ by too much can't be similar
            j = j[(away <= np.maximum(limit[j], limit[i])) & (np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]))]
            for at in range(0, len(j), 64):
                k = j[at : at + 64]
                k = k[group[k] != group[i]]
                if not len(k):
                    continue
                flat = np.concatenate([sets[x] for x in k])
                place = np.minimum(np.searchsorted(sets[i], flat), max(0, size[i] - 1))
                shared = (sets[i][place] == flat) if size[i] else np.zeros(len(flat), dtype=bool)
                both = np.bincount(np.repeat(np.arange(len(k)), size[k]), weights=shared, minlength=len(k))
                for x in k[both >= similarity * (size[k] + size[i] - both)]:
                    found.append((i, int(x)))
                    group[group == group[x]] = group[i]
        if found:
            x, y = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(reps[x], reps[y])), pa.array(np.minimum(reps[x], reps[y]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "bucket"):
            yield from linked(table)
        trim()

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, miss: float = MISS) -> DataFrame:
    """``id_col`` and ``keeper`` of each document that goes: near copies of a text, but for the smallest id among them.

    Texts with the same words are copies whatever their spaces and case; texts without words are copies of one
    another. Other texts are linked if at least ``similarity`` of all their shingles are shared (Jaccard, sets), which
    is verified on whole texts; what links connect is one group. Each text is verified with its nearest partner first.
    Then all texts that have candidates outside their group so far, those that are linked by now included, are gathered
    into clusters of candidates, and in each all pairs between groups are verified in blocks of texts. So the groups
    are those of all links, but for the pairs that never meet or are ruled out (``miss``). Rows with a null id aren't
    judged. A repeated id is one document if its texts are the same.
    """
    known = docs.where(F.col(id_col).isNotNull())
    bits, tables = plan(known.count(), similarity, miss)
    signed = written(_signed(known, id_col, text_col, width, bits, tables, similarity), "signed")
    kept = [F.any_value(c).alias(c) for c in ("s0", "s1", "words", "least")]
    nodes = written(signed.groupBy("k1", "k2").agg(F.min("id").cast("bigint").alias("rep"), *kept), "nodes")
    found = written(_candidates(nodes, bits, similarity, "nearest"), "candidates")
    wanted = found.select(F.col("a").alias("rep"))
    texts = known.select(F.col(id_col).cast("bigint").alias("rep"), text_or_empty(text_col).alias("text"))
    texts = written(sized_join(texts, wanted, ["rep"], "left_semi").groupBy("rep").agg(F.min("text").alias("text")), "texts")
    links = written(_verified(found.where("b is not null").select("a", "b"), texts, width, similarity), "verified")
    groups = written(components(links), "groups")
    rest = nodes.join(texts.select("rep"), "rep", "left_semi").join(groups.select(F.col("node").alias("rep"), "root"), "rep", "left")
    rest = written(rest.withColumn("label", F.coalesce("root", "rep")).drop("root", "k1", "k2"), "labelled")
    clusters = written(components(written(contracted(_candidates(rest, bits, similarity, "open")), "open")), "clusters")
    members = clusters.select(F.col("node").alias("rep"), F.col("root").alias("cluster")).join(rest.select("rep", "label", "s0", "s1"), "rep").join(texts, "rep")
    more = written(_compared(members, width, similarity), "verified")
    groups = written(components(links.unionByName(more)), "groups")
    discard(texts, rest, found, clusters)
    roots = nodes.select("k1", "k2", "rep").join(groups, nodes["rep"] == groups["node"], "left").select("k1", "k2", F.coalesce("root", "rep").alias("keeper"))
    gone = signed.select("id", "k1", "k2").join(roots, ["k1", "k2"]).where(F.col("id") != F.col("keeper"))
    return gone.select(F.col("id").alias(id_col), "keeper")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, miss: float = MISS) -> DataFrame:
    """The rows of ``docs`` but for the near copies: one document of each group stays, that of the smallest id.

    Rows that repeat an id go or stay together; rows with a null id stay.
    """
    gone = near_copies(docs, id_col, text_col, width, similarity, miss).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*own_columns(docs))
