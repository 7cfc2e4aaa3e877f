"""The few functions that built-in expressions can't say, as Arrow-batched pandas functions."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillspark.functions.text import lexical

FUZZY, VERIFIED = 0.8, 0.98


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings (Ratcliff and Obershelp); not an edit distance."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def score_answer(answer: Column, expected: Column, threshold: float = FUZZY) -> Column:
    """``exact``, ``contains``, ``fuzzy`` or ``wrong``, by normalised texts. An empty expectation is contained in anything.

    Only pairs that are neither equal nor contained reach Python.
    """
    a, e = lexical(F.coalesce(answer, F.lit(""))), lexical(F.coalesce(expected, F.lit("")))
    plain = F.when(a == e, "exact").when(F.contains(a, e), "contains")
    ratio = similarity(F.when(plain.isNull(), a), F.when(plain.isNull(), e))
    return F.coalesce(plain, F.when(ratio >= threshold, "fuzzy"), F.lit("wrong"))


def answer_verified(answer: Column, source: Column, threshold: float = VERIFIED) -> Column:
    """Whether an answer stands in its source: a normalised substring, or nearly the whole of it."""
    a, s = lexical(F.coalesce(answer, F.lit(""))), lexical(F.coalesce(source, F.lit("")))
    found = F.contains(s, a)
    ratio = similarity(F.when(~found, a), F.when(~found, s))
    return F.when(a == "", F.lit(False)).otherwise(found | F.coalesce(ratio >= threshold, F.lit(False)))


def json_span(text: str | None) -> tuple[str | None, str | None]:
    """The first bracketed block of a text that parses as JSON, or what is wrong. Kinds of brackets aren't matched up
    while balancing, as the parser does that; brackets within strings don't count."""
    if text is None or not text.strip():
        return None, "empty"
    begin = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    if begin < 0:
        return None, "no block"
    depth, at, n = 0, begin, len(text)
    while at < n:
        ch = text[at]
        if ch == '"':
            at += 1
            while at < n and text[at] != '"':
                at += 2 if text[at] == "\\" else 1
        elif ch in "[{":
            depth += 1
        elif ch in "]}":
            depth -= 1
            if not depth:
                block = text[begin : at + 1]
                try:
                    return json.dumps(json.loads(block), ensure_ascii=False, sort_keys=True), None
                except ValueError:
                    return None, "not JSON"
        at += 1
    return None, "unbalanced"


@F.pandas_udf(StructType([StructField("block", StringType()), StructField("error", StringType())]))
def parse_json_block(text: pd.Series) -> pd.DataFrame:
    """``block``: canonical text of the first JSON block, ``error``: why there is none. Never a default."""
    return pd.DataFrame([json_span(t) for t in text], columns=["block", "error"])
