"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

Unit vectors are rotated at random. Of each, a table of codes keeps the signs z > 0 as packed bits, which stand for the
unit vector x = sign(z) / sqrt(D), the factor f = <x, z>, and z itself in four bits a dimension (planes of bits, rounded
with a random dither). For any other rotated vector w, <x, w> / f is an unbiased estimate of the cosine, whose error has
a standard deviation of sqrt((1 - f^2) / f^2 / (D - 1)), and rounding w adds half a step at most. So a pair is
bounded by counting common bits of one code and the other's planes, either way.

Candidates share a run of code bits: ``tables`` runs of ``bits`` bits. Two vectors at the threshold agree in a bit with
probability 1 - acos(threshold) / pi, so the number of tables follows from the chance ``miss`` of meeting in none.
``bits`` follows the logarithm of the largest group, which keeps the buckets short at any size.

Buckets get codes, not vectors. Pairs whose upper bound is below the threshold are dropped there; only vectors of pairs
that the bounds leave open are fetched, into the buckets where they met, and compared exactly: no pair below the
threshold is ever linked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import discard, sized_join, written
from quillspark.llm.graph import components, roots

SEED = 11
#: Rows of a bucket that are compared in one piece; larger buckets are cut into blocks, and the pairs of blocks are
#: dealt out to different tasks.
BLOCK_ROWS = 512
#: Pairs compared at once.
PAIRS = 400_000
#: Bits a dimension of rounded vectors, and least dimensions that an estimate is taken over.
PLANES, LEAST_DIM = 4, 64


def plan(largest: int, threshold: float, miss: float) -> tuple[int, int]:
    """``bits`` of a bucket's key and number of ``tables``."""
    bits = min(40, max(4, math.ceil(math.log2(max(largest, 1) / 4 + 1))))
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, 1 if agree >= 1 else math.ceil(math.log(miss) / math.log(1 - agree))


def rotations(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    """``n`` random orthogonal matrices, one below the other."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(n):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out).astype(np.float64) if out else np.zeros((0, dim))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def usable(vec: Column) -> Column:
    """Neither null, empty nor zero, with nothing but finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


class Codes:
    """Codes of vectors of one dimension: packed signs, correction factors, rounded vectors as planes of bits."""

    def __init__(self, dim: int, bits: int, tables: int):
        self.turns = math.ceil(LEAST_DIM / dim)
        self.dim, self.bits, self.tables, self.d = dim, bits, tables, dim * self.turns
        self.all_turns = max(self.turns, math.ceil(bits * tables / dim))
        self.words = math.ceil(dim * self.all_turns / 64)  # of all signs
        self.own = math.ceil(self.d / 64)  # of those that estimates are taken from
        self.width = 16 + 8 * (self.words + PLANES * self.own)

    def _packed(self, bits: np.ndarray, words: int) -> np.ndarray:
        padded = np.zeros((len(bits), words * 64), dtype=bool)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u8")

    def encode(self, u: np.ndarray, seed: int) -> np.ndarray:
        """``width`` bytes for each unit vector: dimension, factor, lowest value, step; signs; planes."""
        turned = u @ rotations(self.dim, self.all_turns, seed).T
        z = turned[:, : self.d] / math.sqrt(self.turns)
        low = z.min(axis=1)
        step = np.maximum((z.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
        dither = np.random.default_rng([seed, self.dim, 1]).random(self.d)
        rounded = np.clip(np.floor((z - low[:, None]) / step[:, None] + dither), 0, 2**PLANES - 1).astype(np.uint8)
        head = np.zeros((len(u), 4), dtype="<f4")
        head[:, 0], head[:, 1], head[:, 2], head[:, 3] = self.dim, np.abs(z).sum(axis=1) / math.sqrt(self.d), low, step
        planes = [self._packed((rounded >> k) & 1 != 0, self.own) for k in range(PLANES)]
        return np.concatenate([x.view(np.uint8).reshape(len(u), -1) for x in (head, self._packed(turned > 0, self.words), *planes)], axis=1)

    def read(self, packed: np.ndarray) -> None:
        head = packed[:, :16].copy().view("<f4").astype(np.float64)
        self.f, self.low, self.step = head[:, 1], head[:, 2], head[:, 3]
        rest = packed[:, 16:].copy().view("<u8")
        self.signs = rest[:, : self.words]
        self.planes = rest[:, self.words :].reshape(len(packed), PLANES, self.own)
        rest_bits = self.own * 64 - self.d
        self.code = self.signs[:, : self.own].copy()
        if rest_bits:  # signs of further rotations aren't a part of the estimate
            self.code[:, -1] &= np.uint64((1 << (64 - rest_bits)) - 1)
        self.ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.int64)
        weights = (1 << np.arange(PLANES)).astype(np.int64)
        self.total = (np.bitwise_count(self.planes).sum(axis=2, dtype=np.int64) * weights).sum(axis=1)

    def keys(self) -> np.ndarray:
        """The key of each row in each table."""
        bits = np.unpackbits(self.signs.view(np.uint8).reshape(len(self.signs), -1), axis=1, bitorder="little")[:, : self.bits * self.tables]
        return bits.reshape(len(bits), self.tables, self.bits).astype(np.int64) @ (1 << np.arange(self.bits)).astype(np.int64)

    def estimates(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Unbiased estimates of cosines, from the codes of ``i`` and the rounded vectors ``j``."""
        common = np.zeros(len(i), dtype=np.int64)
        for w in range(self.own):
            code = self.code[i, w]
            for k in range(PLANES):
                common += np.bitwise_count(code & self.planes[j, k, w]).astype(np.int64) << k
        product = self.low[j] * (2 * self.ones[i] - self.d) + self.step[j] * (2 * common - self.total[j])
        return product / (math.sqrt(self.d) * self.f[i])

    def bounds(self, i: np.ndarray, j: np.ndarray, sigmas: float) -> np.ndarray:
        """Upper bounds of the cosines of pairs, the lower of both ways."""
        spread = np.maximum(0.0, 1 - self.f * self.f) / max(1, self.d - self.turns)
        sides = [self.estimates(a, b) + sigmas * np.sqrt(spread[a] + self.step[b] ** 2 / 4) / self.f[a] for a, b in ((i, j), (j, i))]
        return np.minimum(*sides)


def _group_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) within runs of rows, for runs of a bounded length."""
    each = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    later = sizes[each] - within - 1
    i = np.repeat(starts[each] + within, later)
    j = i + 1 + np.arange(int(later.sum())) - np.repeat(np.cumsum(later) - later, later)
    return i, j


def _cells(grp: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One 64-bit number for group, table and key."""
    x = keys.astype(np.uint64)
    for salt in (np.arange(keys.shape[1], dtype=np.uint64)[None, :] + np.uint64(1), grp.view(np.uint64)[:, None]):
        x = x ^ salt * np.uint64(0x9E3779B97F4A7C15)
        for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
        x = x ^ (x >> np.uint64(31))
    return x.view(np.int64)


def _met(codes: Codes, keys: np.ndarray, table: np.ndarray, block: np.ndarray, across: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: float, sigmas: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within runs of rows whose bounds reach the threshold; each in one bucket only: that of the first table in
    which both meet, and in a large bucket that of their blocks."""
    count = sizes * (sizes - 1) // 2
    k = 0
    while k < len(starts):
        upto = max(k + 1, k + int(np.searchsorted(np.cumsum(count[k:]), PAIRS, side="right")))
        i, j = _group_pairs(starts[k:upto], sizes[k:upto])
        for a in range(0, len(i), PAIRS):
            x, y = i[a : a + PAIRS], j[a : a + PAIRS]
            ok = (~across[x] | (block[x] != block[y])) & (table[x] == table[y])
            x, y = x[ok], y[ok]
            ok = codes.bounds(x, y, sigmas) >= threshold
            x, y = x[ok], y[ok]
            ok = (keys[x] == keys[y]).argmax(axis=1) == table[x]
            ok &= keys[x, table[x]] == keys[y, table[x]]
            yield x[ok], y[ok]
        k = upto


def _runs(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and lengths of runs of two rows or more."""
    starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))[: len(bucket)]
    sizes = np.diff(np.concatenate([starts, [len(bucket)]]))
    return starts[sizes > 1], sizes[sizes > 1]


def _by_bucket(batches: Iterator[pa.RecordBatch], compared: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows between buckets; a bucket has at most about two blocks of rows."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for at in range(0, whole.num_rows, 4000):
            batch = whole.slice(at, 4000)
            b = batch.column("bucket").to_numpy()
            cut = int(np.searchsorted(b, b[-1]))
            if cut:
                yield from compared(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
    if held:
        yield from compared(pa.Table.from_batches(held))


def _of_runs(chunk: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows that don't stand alone in their bucket, and the runs of those."""
    starts, sizes = _runs(chunk.column("bucket").to_numpy())
    use = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return chunk.take(pa.array(use)).combine_chunks(), np.cumsum(sizes) - sizes, sizes


def _bytes(column: pa.ChunkedArray | pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), dtype=np.uint8).reshape(len(rows), width)


def coded(reps: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """The table of codes: ``rep``, ``code`` (see ``Codes.encode``), and ``cells``, the 64-bit number of each table's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                lengths = np.diff(batch.column("vec").offsets.to_numpy())
                for dim in np.unique(lengths).tolist():
                    part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                    codes = Codes(dim, bits, tables)
                    packed = codes.encode(unit(_matrix(part.column("vec"))), seed)
                    codes.read(packed)
                    cells = pa.array(list(_cells(part.column("grp").to_numpy(), codes.keys())), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([x.tobytes() for x in packed], pa.binary()), cells], names=["rep", "code", "cells"])

    return reps.select("rep", "grp", "vec").mapInArrow(run, "rep bigint, code binary, cells array<bigint>")


def undecided(codes: DataFrame, bits: int, tables: int, threshold: float, sigmas: float, block_rows: int) -> DataFrame:
    """Of pairs that meet and whose bounds leave a link open: ``rep`` of both, with the ``bucket`` where they met."""
    each = codes.select("rep", "code", F.posexplode("cells").alias("tbl", "cell"))
    hot = codes.select(F.explode("cells").alias("cell")).groupBy("cell").count().where(F.col("count") > block_rows)
    hot = written(hot.select("cell", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")), "hot")
    rows = sized_join(each, hot, ["cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda k: F.struct(F.least("block", k).alias("lo"), F.greatest("block", k).alias("hi")))
    rows = rows.withColumn("meet", F.explode(meets)).withColumn("bucket", F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "meet")))
    rows = rows.select("bucket", "rep", "tbl", "block", (F.col("meet.lo") != F.col("meet.hi")).alias("across"), "code").repartition("bucket").sortWithinPartitions("bucket")

    def compared(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        chunk, starts, sizes = _of_runs(chunk)
        if not len(sizes):
            return
        column = chunk.column("code")
        lengths = pc.binary_length(column).to_numpy()
        table, block, across = (chunk.column(c).to_numpy() for c in ("tbl", "block", "across"))
        open_ = np.zeros(chunk.num_rows, dtype=bool)
        for n in np.unique(lengths).tolist():
            # vectors of one bucket have one dimension, of a chunk perhaps several; those of one width are taken apart by it
            width = np.flatnonzero(lengths == n)
            packed = _bytes(column, width, n)
            dims = packed[:, :4].copy().view("<f4")[:, 0].astype(int)
            for dim in np.unique(dims).tolist():
                mine = np.zeros(chunk.num_rows, dtype=bool)
                mine[width[dims == dim]] = True
                codes = Codes(dim, bits, tables)
                codes.read(packed[dims == dim])
                own = mine[starts]
                place = np.cumsum(mine) - 1
                rows_ = np.flatnonzero(mine)
                for x, y in _met(codes, codes.keys(), table[rows_], block[rows_], across[rows_], place[starts[own]], sizes[own], threshold, sigmas):
                    open_[rows_[x]] = open_[rows_[y]] = True
        yield pa.RecordBatch.from_struct_array(chunk.select(["bucket", "rep", "tbl", "block", "across"]).filter(pa.array(open_)).to_struct_array().combine_chunks())

    return rows.mapInArrow(lambda b: _by_bucket(b, compared), "bucket bigint, rep bigint, tbl int, block int, across boolean")


def links(reps: DataFrame, threshold: float, miss: float = 1e-6, sigmas: float = 5.0, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links between distinct vectors (``rep``: a number of its own, ``grp``: fixes label and dimension, ``vec``, ``mult``).

    Returns partial results to be summed and joined up: ``rep``, ``links`` (rows linked to it, by ``mult``), ``root`` (a
    smaller vector of its component or itself), ``n_exact`` (cosines that were computed exactly, on one row of each chunk).
    Buckets never emit their pairs, only a row per vector that is still in question.
    """
    largest = reps.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, threshold, miss)
    codes = written(coded(reps, bits, tables, seed), "codes")
    found = written(undecided(codes, bits, tables, threshold, sigmas, block_rows), "undecided")
    discard(codes)
    rows = sized_join(found, reps.select("rep", "grp", "mult", "vec"), ["rep"], "inner").repartition("bucket").sortWithinPartitions("bucket")

    def compared(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        chunk, starts, sizes = _of_runs(chunk)
        if not len(sizes):
            return
        vec = chunk.column("vec")
        vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
        lengths = np.diff(vec.offsets.to_numpy())
        reps_, mult, grp, table, block, across = (chunk.column(c).to_numpy() for c in ("rep", "mult", "grp", "tbl", "block", "across"))
        found_i, found_j, n_exact = [], [], 0
        for dim in np.unique(lengths).tolist():
            rows_ = np.flatnonzero(lengths == dim)
            u = unit(_matrix(vec.take(pa.array(rows_))))
            mine = Codes(dim, bits, tables)
            mine.read(mine.encode(u, seed))
            own = lengths[starts] == dim
            place = np.cumsum(lengths == dim) - 1
            for x, y in _met(mine, mine.keys(), table[rows_], block[rows_], across[rows_], place[starts[own]], sizes[own], threshold, sigmas):
                same = grp[rows_[x]] == grp[rows_[y]]
                x, y = x[same], y[same]
                n_exact += len(x)
                ok = np.einsum("ij,ij->i", u[x], u[y]) >= threshold
                found_i.append(rows_[x[ok]])
                found_j.append(rows_[y[ok]])
        i, j = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (found_i, found_j))
        nodes, place = np.unique(reps_, return_inverse=True)
        total = np.bincount(place[i], weights=mult[j], minlength=len(nodes)) + np.bincount(place[j], weights=mult[i], minlength=len(nodes))
        root = roots(len(nodes), place[i], place[j])
        have = np.flatnonzero((total > 0) | (np.arange(len(nodes)) == 0))  # the first row has the number of exact cosines
        exact = np.where(have == 0, n_exact, 0)
        yield pa.RecordBatch.from_pydict({"rep": pa.array(nodes[have]), "links": pa.array(total[have].astype(np.int64)), "root": pa.array(nodes[root[have]]), "n_exact": pa.array(exact)})

    flat = rows.select("bucket", "rep", "tbl", "block", "across", "grp", "mult", "vec")
    return flat.mapInArrow(lambda b: _by_bucket(b, compared), "rep bigint, links bigint, root bigint, n_exact bigint")


def clusters(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, miss: float = 1e-6, sigmas: float = 5.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``embeddings``: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Vectors are compared only if their labels are equal and not null, and their lengths too; a vector that is null,
    empty, zero, or holds a null or non-finite component links with nothing, nor does one with a null id (its component
    and ``kept`` are null). ``n_links`` counts the other rows with a cosine of at least ``threshold``; ``component_id`` is
    the smallest id reachable. Equal vectors are one node that counts as many times, so copies cost nothing. Every
    link is checked exactly in double precision; the chance that a link at the threshold isn't found is about ``miss``.
    """
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    good = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    marked = rows.select("id", "vec", "label", good.alias("good"))
    marked = marked.withColumn("h1", F.when(F.col("good"), F.xxhash64("label", "vec"))).withColumn("h2", F.when(F.col("good"), F.xxhash64("label", "vec", F.lit(1))))
    marked = marked.withColumn("grp", F.xxhash64("label", F.size("vec")))
    reps = marked.where("good").groupBy("h1", "h2").agg(F.min("id").cast("bigint").alias("low"), F.count("*").alias("mult"), F.any_value("grp").alias("grp"), F.any_value("vec").alias("vec"))
    reps = written(reps.withColumnRenamed("h1", "rep"), "vectors")
    part = written(links(reps, threshold, miss, sigmas, SEED, block_rows), "links")
    found = components(part.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    total = part.groupBy("rep").agg(F.sum("links").alias("links"))
    nodes = reps.select("rep", "h2", "low", "mult").join(total, "rep", "left").join(found, "rep", "left")
    nodes = written(nodes.select("rep", "h2", "low", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "root"), "nodes")
    lowest = nodes.where("root is not null").groupBy("root").agg(F.min("low").alias("component"))
    nodes = nodes.join(lowest, "root", "left").select(F.col("rep").alias("h1"), "h2", "n_links", F.coalesce("component", "low").alias("component_id"))
    out = marked.select("id", "h1", "h2").join(nodes, ["h1", "h2"], "left")
    component = F.coalesce("component_id", F.col("id").cast("bigint"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


EMBEDDINGS_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
k as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
r(n, c) as (select vec_id, vec_id from embeddings union select r.n, k.b from r join k on r.c = k.a),
m as (select n, min(c) as component_id from r group by n),
l as (select a, count(*) as n_links from k group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings left join m on n = vec_id left join l on a = vec_id
"""
