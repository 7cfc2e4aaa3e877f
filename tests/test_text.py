import math
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import python, register, stats, text


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)) if columns else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


def plain_norm(s):
    s = s.casefold().strip()
    s = re.sub(r"(?<=\d),(?=\d{3}\b)", "", s)
    s = re.sub(r"(\d)(st|nd|rd|th)\b", r"\1", s)
    return " ".join(re.sub(r"[^\w\s]", " ", s).split())


@pytest.mark.parametrize("s", ["1,000 Tons, 3rd.", "Straße CAFÉ", "½ ² ١٢٣,٤٥٦", "a b c", "1,000,000,000", "😀 ok", "", "   ", "12,34 1,2345", "March 4th, 1848"])
def test_normalize(spark, s):
    assert one(spark, text.normalize("s"), s=s) == plain_norm(s)


def test_normalize_null(spark):
    assert spark.sql("select cast(null as string) as s").select(text.normalize("s")).first()[0] is None


@pytest.mark.parametrize("expected,answer,passage,anchored,correct", [
    ("1,000 tons", "1000 tons", "a ship of 1,000 tons", True, True), ("4 March 1848", "March 4th, 1848", "on 4 March 1848 the brig", True, True),
    ("purple elephant", "purple elephant", "the brig sailed", False, False), ("", "", "", False, False), ("nineteen", "nineteen hands in all", "a crew of nineteen", True, True),
])
def test_grade(spark, expected, answer, passage, anchored, correct):
    g = one(spark, text.grade("e", "a", "p"), e=expected, a=answer, p=passage)
    assert (g.anchored, g.correct) == (anchored, correct)


@pytest.mark.parametrize("a,b,value", [("x y", "y x", 1.0), ("x", "y", 0.0), ("a b c", "b c d", 0.5), ("", "a", 0.0)])
def test_jaccard(spark, a, b, value):
    assert one(spark, text.jaccard(text.token_set(text.lexical("a")), text.token_set(text.lexical("b"))), a=a, b=b) == value


@pytest.mark.parametrize("s,n", [("", 0), ("   \n ", 0), ("abcd", 1), ("abcde", 2), ("a-b", 3), ("a b", 2), ("é", 1)])
def test_approx_count(spark, s, n):
    assert one(spark, text.approx_count("s"), s=s) == n


@pytest.mark.parametrize("s,v", [("> Wrong, as", "wrong"), ("grader_wrong", "grader_wrong"), ("it is partial", "partial"), ("hm", "unparsed"), (None, "unparsed"), ("wrong or grader_wrong", "wrong"), ("see: wrong or grader_wrong", "grader_wrong")])
def test_parse_verdict(spark, s, v):
    assert one(spark, text.parse_verdict("s"), s=s) == v


def test_structural_strip(spark):
    assert one(spark, text.structural_strip("s"), s="# Head\n---\n\n- **bold**  x\n2) two\n> said\n****\n") == "Head\nbold x\ntwo\nsaid"


@pytest.mark.parametrize("s,want", [
    ("a\u2028b\x0bc\x85d", "a\nb\nc\nd"), ("\u0661\u0662. x", "x"), ("#\n- x", "x"), ("# - 3) x", "x"), ("-\n- ", "-\n-"), ("_**_ x", "x"), ("** > x", "> x"), ("> # x", "# x"), ("  ==== \n a \u00a0 b ", "a b"), ("", ""), ("***", ""), ("a\r\n\r\nb", "a\nb"),
])
def test_structural_strip_of_odd_lines(spark, s, want):
    assert one(spark, text.structural_strip("s"), s=s) == want


@pytest.mark.parametrize("b,c,p", [(1, 9, 0.021484), (91, 38, 3e-06), (69, 45, 0.030776), (0, 0, 1.0), (1, 0, 1.0), (5, 5, 1.0), (50_100_000, 50_000_000, 0.0), (50_000_500, 50_000_000, 0.960194), (10**9, 10**9, 1.0)])
def test_exact_test_of_many_pairs(spark, b, c, p):
    row = spark.createDataFrame([(b, c)], "b bigint, c bigint").select(stats.mcnemar_p(F.col("b"), F.col("c"), F.lit(1)).alias("p")).first()
    assert abs(row.p - p) < 2e-5


@pytest.mark.parametrize("s,parts", [("a\n\nb", ["a", "b"]), ("A. B! C? D.", ["A. B!", "C? D."]), ("A. B", ["A.", "B"]), ("", [])])
def test_split_paragraphs(spark, s, parts):
    assert one(spark, text.split_paragraphs("s"), s=s) == parts


@pytest.mark.parametrize("s,ok", [('{"a":1}', True), ('{"a": 1}', False), ("x", False), ('["a\\"b",-1.5e3,true]', True)])
def test_json_tokens(spark, s, ok):
    assert (one(spark, text.json_tokens("s"), s=s) is not None) == ok


@pytest.mark.parametrize("s,ok,matched", [("[]", True, []), ("[3, 1, 3]", True, [1, 3]), ("[9]", False, None), ('["x"]', False, None), ("oops", False, None), ("[true]", False, None), ("[1.0]", False, None)])
def test_fact_check(spark, s, ok, matched):
    c = one(spark, text.fact_check("s", F.lit(5)), s=s)
    assert (c.parse_ok, c.facts_matched) == (ok, matched)


@pytest.mark.parametrize("b,c,n,p", [(1, 9, 20, 0.021484), (0, 0, 5, 1.0), (0, 0, 0, None), (1, 0, 3, 1.0), (91, 38, 662, 3e-06), (69, 45, 635, 0.030776), (3000, 2900, 9000, None)])
def test_mcnemar(spark, b, c, n, p):
    got = spark.range(1).select(stats.mcnemar_p(F.lit(b), F.lit(c), F.lit(n)).alias("p")).first().p
    if b == 3000:
        total, low = b + c, min(b, c)
        p = round(min(1.0, 2 * sum(math.exp(math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1) - total * math.log(2)) for i in range(low + 1))), 6)
    assert got == p


def test_wilson(spark):
    rows = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (59, 100)], "k int, n int").select("k", "n", *[c.alias(a) for c, a in zip(stats.wilson(F.col("k"), F.col("n")), ("lo", "hi"), strict=True)]).orderBy("n", "k").collect()
    assert (rows[0].lo, rows[0].hi) == (None, None) and rows[1].lo == 0 and rows[2].hi == 1
    z, p, n = stats.Z, 0.59, 100
    mid, half, den = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    assert (rows[3].lo, rows[3].hi) == (round((mid - half) / den, 6), round((mid + half) / den, 6))


def test_ratio_and_savings(spark):
    row = spark.range(1).select(stats.ratio(F.lit(0.25), F.lit(0.5)).alias("a"), stats.ratio(F.lit(1), F.lit(0)).alias("b"), stats.savings(F.lit(100), F.lit(40)).alias("c"), stats.savings(F.lit(0), F.lit(4)).alias("d")).first()
    assert tuple(row) == (0.5, None, 60.0, None)


def test_bootstrap_is_stable_and_brackets(spark):
    rows = spark.createDataFrame([(f"t{i % 9}", (i * 7) % 10 < 6) for i in range(200)], "task string, ok boolean")
    a, b = (stats.cluster_bootstrap(r, "task", "ok", 300).first() for r in (rows, rows.repartition(7)))
    assert a == b and a.lo <= 0.6 <= a.hi
    assert stats.cluster_bootstrap(rows.limit(0), "task", "ok", 10).first().lo is None


@pytest.mark.parametrize("answer,expected,verdict", [("The Ship!", "the ship", "exact"), ("a the ship b", "the ship", "contains"), ("the shipp", "the ships", "fuzzy"), ("x", "the ship", "wrong"), ("x", "", "contains"), (None, "y", "wrong")])
def test_score_answer(spark, answer, expected, verdict):
    assert one(spark, python.score_answer(F.col("a"), F.col("e")), a=answer, e=expected) == verdict


@pytest.mark.parametrize("answer,source,ok", [("Brig", "the brig sailed", True), ("", "x", False), ("no", "brig", False)])
def test_answer_verified(spark, answer, source, ok):
    assert one(spark, python.answer_verified(F.col("a"), F.col("s")), a=answer, s=source) == ok


@pytest.mark.parametrize("raw,block,error", [('so: [1, "]"] end', '[1, "]"]', None), ("none", None, "no block"), (None, None, "empty"), ('{"a": [1}', None, "unbalanced"), ('{"a": [1}}', None, "not JSON"), ('{"q": "\\"}"}', '{"q": "\\"}"}', None)])
def test_json_span(raw, block, error):
    assert python.json_span(raw) == (block, error)


def test_sql_registration(spark):
    names = register(spark)
    assert "quill_containment" in names
    row = spark.sql("select quill_normalize('1,000 Tons, 3rd.') a, quill_containment('a b', 'b c d') b, quill_approx_count('abcde f') c, quill_jaccard('a b c', 'b c d') d").first()
    assert tuple(row) == ("1000 tons 3", 0.5, 3, 0.5)


def test_usage_prompt_and_inversion(spark):
    good = '{"usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3, "completion_tokens_details": {"reasoning_tokens": 1}}}'
    assert tuple(one(spark, text.usage("s"), s=good)) == (1, 2, 3, 1)
    with pytest.raises(Exception, match="total_tokens"):
        one(spark, text.usage("s"), s='{"usage": {"prompt_tokens": 1, "completion_tokens": 2}}')
    assert one(spark, text.prompt("a %s b %s", "s", F.lit(None)), s="x") == "a x b "
    assert spark.range(1).select(text.inverted(F.create_map(F.lit("a"), F.lit(1))).alias("m")).first().m == {1: "a"}
    assert one(spark, text.canonical_hash("b", "a"), a="1", b="2") == one(spark, text.canonical_hash("a", "b"), b="2", a="1")
