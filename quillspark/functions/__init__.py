"""Column functions, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

def register(spark: SparkSession) -> list[str]:
    """Make the text kernel callable in ``spark.sql``: temporary SQL functions over built-in expressions, and the two
    functions that need Python. Returns their names."""
    from quillspark.functions.python import parse_json_block, similarity

    sql = {
        "quill_normalize": ("STRING", r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(x), 'ß', 'ss'), r'(?U)(?<=\p{Nd}),(?=\p{Nd}{3}\b)', ''), r'(?U)(\p{Nd})(st|nd|rd|th)\b', '$1'), r'(?U)[^\p{L}\p{N}_\s]', ' '), r'(?U)\s+', ' '))"),
        "quill_approx_count": ("BIGINT", r"cast(length(regexp_replace(regexp_replace(x, '[A-Za-z0-9]{1,4}', 'x'), r'(?U)\s+', '')) as bigint)"),
    }
    for name, (kind, body) in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    sets = "array_remove(array_distinct(split(quill_normalize({}), ' ')), '')"
    a, b = sets.format("a"), sets.format("b")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quill_containment(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN least(size({a}), size({b})) > 0 THEN size(array_intersect({a}, {b})) / least(size({a}), size({b})) ELSE 0.0d END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quill_jaccard(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN size({a}) > 0 AND size({b}) > 0 THEN round(size(array_intersect({a}, {b})) / size(array_union({a}, {b})), 6) ELSE 0.0d END")
    spark.udf.register("quill_similarity", similarity)
    spark.udf.register("quill_parse_json_block", parse_json_block)
    return [*sql, "quill_containment", "quill_jaccard", "quill_similarity", "quill_parse_json_block"]
