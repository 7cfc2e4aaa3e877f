"""Importance resampling towards a target distribution, over hashed n-grams whose CRCs are composed, not computed.

Texts are read twice: once to count buckets, once to sum the gains of each document's features. Between the two there is
one row per bucket, whatever the corpus. What follows works on a number or two per document: a Gumbel draw is added to
the weight, and the highest sums are the sample, numbered by ranges of the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import crc
from quillspark.llm._shared import numbered, slices, trim, written

#: Words in a feature at most; buckets; added to each bucket's count; share of the documents drawn, in percent; words that
#: a document must have to be drawn.
ORDER, BUCKETS, SMOOTH, PERCENT, LEAST_WORDS = 1, 10_000, 1, 10, 20
SEED = "2024"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words, once A-Z are lower: digits, a-z, and all of other letters and signs beyond ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def features(texts: pa.Array, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and owner (place of the text) of each feature, and the number of words of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    edge = edge[:-1]  # first bytes of texts: a word ends before them
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    last = np.concatenate([edge[1:], [True]]) if len(data) else edge
    ends = np.flatnonzero(inside & (~after | last)) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    own = crc.words(data, starts, ends)
    hashed, owners = crc.runs(own, ends - starts, owner, order)
    return (hashed % np.uint32(buckets)).astype(np.int64), owners, np.bincount(owner, minlength=len(texts))


def bucket_counts(docs: DataFrame, text_col: str, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features in each bucket, over all whole texts. Tasks add up before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                total += np.bincount(features(part.column(0), order, buckets)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": hit, "n": total[hit]})
        trim()

    return docs.select(F.col(text_col)).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_col: str, order: int, buckets: int) -> np.ndarray:
    """1,000 times the log of each bucket's ratio of smoothed shares, rounded down. One number a bucket on the driver."""
    both = bucket_counts(docs, text_col, order, buckets).withColumnRenamed("n", "s").join(bucket_counts(target, target_col, order, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    got = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).toPandas()  # a row a bucket at most
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[got["bucket"]], t[got["bucket"]] = got["s"], got["t"]
    pad = float(SMOOTH * buckets)
    return np.floor(1000 * np.log((t + SMOOTH) * (s.sum() + pad) / ((s + SMOOTH) * (t.sum() + pad)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, order: int) -> DataFrame:
    """``id, n_words, n_features, weight`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                bucket, owner, n_words = features(part.column(1), order, len(own))
                sums = np.zeros(part.num_rows, dtype=np.int64)
                np.add.at(sums, owner, own[bucket])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(np.bincount(owner, minlength=part.num_rows)), pa.array(sums)], names=["id", "n_words", "n_features", "weight"])
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: str) -> Column:
    """1,000 times a Gumbel draw, rounded down, by the first eight hex digits of a hash of the id (null: of no digits)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_features, weight, score, rank`` (null: not drawn), all long but the id.

    Words are runs of ASCII digits and letters (A-Z lowered) and of anything beyond ASCII; features are runs of 1 to
    ``order`` words, hashed into ``buckets``. A null or empty text has no words: weight 0, never drawn. Without
    target texts the target is flat. Of the N rows with ``least_words`` words, floor(percent * N / 100) are drawn, the
    highest scores, then the smaller ids (null first). Repeated rows count and are drawn as often as they are there,
    in any order among themselves; rows without an id share one draw. An empty table gives none. Other columns are
    left alone. Texts are never shuffled, and the numbering sorts ranges of rows in separate tasks.
    """
    rows = weighed(docs, gains(docs, target, text_col, target_col, order, buckets), id_col, text_col, order)
    scored = written(rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "weights")
    fit = scored.where(F.col("n_words") >= least_words)
    n = fit.count() * percent // 100
    placed = numbered(fit, [F.desc("score"), F.asc("id")], "rank")
    out = placed.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank"))).unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


#: The table of CRC-32 is made in SQL, and each distinct word is folded over it once.
RESAMPLE_SQL = r"""
with recursive bits(i, c, k) as (
  select range::bigint, range::bigint, 0 from range(256)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
tab as materialized (select list(c order by i) as t from bits where k = 8),
d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as materialized (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
dw as materialized (select doc_id, unnest(w) as word from d),
bw as materialized (select unnest(w) as word from b),
v as (select word, hex(encode(word)) as h from (select word from dw union select word from bw)),
u as materialized (select word, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::int + 1, 2))::bigint), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 as bucket from v, tab),
s as (select bucket, count(*) as s from dw join u using (word) group by bucket),
t as (select bucket, count(*) as t from bw join u using (word) group by bucket),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select count(*) from bw) + 10000)::double)))::bigint as gain from s full join t using (bucket)),
p as (select doc_id, sum(gain)::bigint as weight from dw join u using (word) join g using (bucket) group by doc_id),
c as (select doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from d left join p using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as place from c where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= (select count(*) from r) * 10 // 100 then place end as rank from c left join r using (doc_id)
"""
