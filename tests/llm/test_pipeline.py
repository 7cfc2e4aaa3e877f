import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from quillspark.llm import mixing, queries, quality


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, before = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, sf_dir)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(out)
        before = out
    kept, lined, single, mixed = seen
    good = {r.doc_id for r in quality.scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep").collect()}
    assert {r.doc_id for r in kept.collect()} == good and kept.count() < docs.count()
    assert {r.doc_id for r in lined.collect()} == good and lined.where("n_chars <> length(text)").count() == 0
    texts = [" ".join(r.text.lower().split()) for r in single.collect()]
    assert len(texts) == len(set(texts)) and single.join(lined, docs.columns, "left_anti").count() == 0
    taken = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    want = {r.doc_id: (r.taken, r.size) for r in mixing.mix(single).collect()}
    cut = [i for i, (t, s) in want.items() if s and t % s]
    assert all(taken.get(i, 0) * s == t for i, (t, s) in want.items() if i not in cut and s) and len(cut) <= single.select("source").distinct().count()


def test_run_decodes_to_the_mix(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and all(hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 and len(r.ids) == r.n_tokens for r in got)


def test_all_queries_are_there():
    names = {n.split("_")[0] for n in queries.QUERIES if n not in queries.AUDITS}
    assert names == {f"op{i}" for i in range(1, 14)}


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, "w " * 60_000, "en", "s", 120_000), (3, "w " * 60_000, "en", "s", 120_000), (None, "some text\nof two lines", "de", "t", 21)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    labels = "doc_id bigint, quality int, toxic int"
    for k, data in enumerate((rows, [])):
        d = f"{tmp_path}/{k}"
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.count() <= 3 * len(data) and (out.where(F.col("n_tokens") > 0).count() > 0) == bool(data)
