"""SimHash near-duplicates by meet-in-the-middle ball hashing.

``clusters`` links whole 64-bit fingerprints a few bits apart. Texts that share no less than 80 % of their word
shingles differ in about ten of 64 bits, though, and a ball of that radius can't be listed; ``near_copies`` therefore
runs the same ball hashing over several short fingerprints of each text and verifies what collides by its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._shared import slices, written
from quillspark.llm.graph import components

BITS, SEED = 64, 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority of the bits of the XXH64 of all word shingles, repeats included.

    Words are runs of other than ASCII white space, A-Z lower-cased. Fewer words than ``width`` make one shingle; no
    word gives zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    begins = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        begins.append(at)
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[i : j - 1], SEED) for i, j in zip(begins, begins[width:], strict=False)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, CHUNK):
        part = np.ascontiguousarray(h[k : k + CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (bigint: the 64 bits) of each row's whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                fp = np.array([fingerprint(t, width) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "fp": pa.array(fp.view(np.int64))})

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def near_pairs(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links between distinct fingerprints (``fp``, ``rep``) that differ in at most ``radius`` bits, enough to connect.

    Every fingerprint emits the variants within half the radius (rounded up); two fingerprints within the radius meet
    in one of them. All that meet in a variant lie in a ball around it, so there are no more of them than points in
    that ball, however large a group of copies is: no variant can be hot. Each is linked to the smallest it meets;
    links are deduplicated and verified by their own distance. For radius 2, all that meet are within the radius of
    one another, so a star keeps their component whole.

    Returns ``a``, ``b`` (the ``rep`` of both ends).
    """
    if radius not in (0, 1, 2):
        raise ValueError("stars keep components whole for a radius up to 2")
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("bigint") for i in range(BITS)]) if radius else F.array(F.lit(0).cast("bigint"))
    variants = fps.select("fp", "rep", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("variant"))
    ball = Window.partitionBy("variant")
    least = F.min(F.struct("rep", "fp")).over(ball)
    met = variants.withColumn("low", least).where(F.col("low.rep") != F.col("rep"))
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low.fp"))) <= radius)
    return met.select(F.col("rep").alias("a"), F.col("low.rep").alias("b")).distinct()


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links between fingerprints at most ``radius`` bits apart. Texts
    that are null or have no words have fingerprint zero and are linked like any other. Rows with a null id get a
    fingerprint, and the component of the other rows linked to them (null if there are none). Repeated ids are kept.
    Equal fingerprints are one node, so a large group of copies costs no more than one document.
    """
    marked = written(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = written(marked.groupBy("fp").agg(F.min(id_col).alias("rep")).where("rep is not null"), "nodes")
    found = components(near_pairs(nodes, radius))
    roots = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return marked.join(roots, "fp", "left").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
