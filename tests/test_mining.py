import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import mining


def edges_of(texts, least):
    freq = Counter()
    for t in texts:
        head = (t or "")[:4000]
        freq.update({s for n in range(12, min(64, len(head)) + 1) for s in (head[:n], head[-n:])})
    return {s: n for s, n in freq.items() if n >= least}


@pytest.mark.parametrize("least", [1, 2, 5])
def test_edges_are_those_of_brute_force(spark, least):
    """Segments that are frequent only as beginnings, only as ends, or only as both together."""
    rng = random.Random(4)
    phrases = ["the same phrase opens", "and this is how it ends é", "abababababababababab", "x" * 30, "a phrase on either side"]
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
    texts = [rng.choice([*phrases, ""]) + word() + rng.choice([*phrases, ""]) for _ in range(150)] + ["x" * n for n in range(10, 80)] + ["q" + "z" * 5000 + phrases[1]] * 2 + [None, ""]
    texts += [f"a rare phrase {word()}{i}" for i in range(3)] + [f"{i}{word()} a rare phrase " for i in range(2)]  # 3 + 2
    got = mining.edge_candidates(mining.weighted_texts(spark.createDataFrame([(t,) for t in texts], "t string"), "t"), min_freq=least).collect()
    assert {r.segment: r.freq for r in got} == edges_of(texts, least) and len(got) == len({r.segment for r in got})
    assert least != 5 or edges_of(texts, 5)["a rare phrase "] == 5


def test_texts_that_share_nothing_offer_no_segments(spark):
    """What is shuffled for segments is what can be frequent, and never a text."""
    texts = spark.range(2000).select(F.concat(F.md5(F.col("id").cast("string")), F.lit(" - "), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20)).alias("text"), F.lit(1).alias("weight"))
    found = mining.edge_candidates(texts, min_freq=5)
    assert found.count() == 0
    spark.sparkContext.setJobGroup("edges", "edges")
    found.collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("edges") for s in tracker.getJobInfo(j).stageIds}
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 3 * 2000
