"""Text kernel: Column functions for normalising, token sets, overlap, counting and parsing. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR_THRESHOLD = MATCH_THRESHOLD = 0.8
#: The order in which verdicts are looked for.
VERDICTS = ("grader_wrong", "partial", "wrong", "ambiguous")
#: Letters and digits of a token, whatever the script. ``(?U)`` makes \s and \b Unicode-aware.
_NOT_WORD = r"(?U)[^\p{L}\p{N}_\s]"
_SPACES = r"(?U)\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(text: Column | str) -> Column:
    """Lower case, with the one letter whose folded form has two."""
    return F.replace(F.lower(_col(text)), F.lit("ß"), F.lit("ss"))


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def normalize(text: Column | str) -> Column:
    """Fold, drop thousands commas and ordinal endings, turn punctuation into spaces, collapse spaces. Null stays null."""
    x = F.regexp_replace(folded(text), r"(?U)(?<=\p{Nd}),(?=\p{Nd}{3}\b)", "")
    x = F.regexp_replace(x, r"(?U)(\p{Nd})(st|nd|rd|th)\b", "$1")
    return _collapsed(F.regexp_replace(x, _NOT_WORD, " "))


def lexical(text: Column | str) -> Column:
    """``normalize`` without the rules for numbers."""
    return _collapsed(F.regexp_replace(folded(text), _NOT_WORD, " "))


def token_set(normalised: Column | str) -> Column:
    """Distinct tokens of a normalised text; none of an empty one."""
    return F.array_remove(F.array_distinct(F.split(_col(normalised), " ")), "")


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens, 6 places; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(both, 6)).otherwise(F.lit(0.0))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Containment of two raw texts."""
    return containment(token_set(normalize(a)), token_set(normalize(b)))


def anchor_score(expected: Column | str, passage: Column | str) -> Column:
    return overlap(expected, passage)


def match_score(answer: Column | str, expected: Column | str) -> Column:
    return overlap(answer, expected)


def grade(expected: Column | str, answer: Column | str, passage: Column | str, anchor: float = ANCHOR_THRESHOLD, match: float = MATCH_THRESHOLD) -> Column:
    """Both gates on unrounded scores, as a struct: anchor_score, match_score (6 places), anchored, correct."""
    a, m = F.coalesce(anchor_score(expected, passage), F.lit(0.0)), F.coalesce(match_score(answer, expected), F.lit(0.0))
    return F.struct(
        F.round(a, 6).alias("anchor_score"), F.round(m, 6).alias("match_score"), F.lit(anchor).alias("anchor_threshold"), F.lit(match).alias("match_threshold"),
        (a >= anchor).alias("anchored"), ((a >= anchor) & (m >= match)).alias("correct"),
    )


def approx_count(text: Column | str) -> Column:
    """Approximate tokens: four characters of an ASCII letter-digit run cost one, each other character but spaces one."""
    runs = F.regexp_replace(_col(text), "[A-Za-z0-9]{1,4}", "x")
    return F.length(F.regexp_replace(runs, _SPACES, "")).cast("bigint")


def parse_verdict(raw: Column | str) -> Column:
    """A leading verdict wins, else the first of the fixed order found anywhere, else ``unparsed``."""
    text = F.trim(F.lower(_col(raw)))
    lead = F.nullif(F.regexp_extract(text, rf"^[\s>*-]*({'|'.join(VERDICTS)})\b", 1), F.lit(""))
    anywhere = F.coalesce(*[F.when(F.contains(text, F.lit(v)), F.lit(v)) for v in VERDICTS])
    return F.coalesce(lead, anywhere, F.lit("unparsed"))


#: What ends a line; lines that only decorate; what a line of markup may open with, each at most once and
#: in this order; signs of bold text, of which what is left when the first have gone counts too; a quote.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
DECORATION, OPENING, BOLD, QUOTE = r"[-=_*]{3,}", r"(?:#{1,6} *)?(?:[-*+] +)?(?:\p{Nd}+[.)] +)?", (r"\*\*", "__"), "> ?"


def structural_strip(text: Column | str) -> Column:
    """Markdown as compact lines, without decoration, openings, bold signs, quote signs and blank lines.

    The whole text is rewritten at once, in multi-line mode: no line becomes a value of its own.
    """
    at_start = lambda pattern: rf"(?mU)^{pattern}"
    x = F.regexp_replace(F.regexp_replace(_col(text), LINE_ENDS, "\n"), r"(?U)(?:[^\S\n]|\x1f)+", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?m)^ | $", ""), rf"(?m)^{DECORATION}$", "")
    x = F.regexp_replace(x, at_start(OPENING), "")
    for sign in BOLD:
        x = F.regexp_replace(x, sign, "")
    x = F.regexp_replace(F.regexp_replace(x, at_start(QUOTE), ""), " {2,}", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?m)^ +| +$", ""), r"\n{2,}", "\n"), r"^\n|\n$", "")


def split_paragraphs(text: Column | str) -> Column:
    """Paragraphs between blank lines; of a single block its sentences, in pairs if there are four or more."""
    trimmed = lambda parts: F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    paragraphs = trimmed(F.split(_col(text), r"\n\s*\n"))
    sentences = trimmed(F.regexp_extract_all(_col(text), F.lit(r"([^.!?]+[.!?]+(?:\s|$)|[^.!?]+$)"), F.lit(1)))
    starts = F.sequence(F.lit(1), F.size(sentences), F.lit(2))
    pairs = F.transform(starts, lambda i: F.array_join(F.slice(sentences, i, F.lit(2)), " "))
    single = F.when(F.size(sentences) >= 4, pairs).when(F.size(sentences) > 0, sentences).otherwise(paragraphs)
    return F.when(F.size(paragraphs) > 1, paragraphs).otherwise(single)


#: The tokens of JSON without white space.
JSON_TOKEN = r'("(?:[^"\\]|\\.)*"|[{}\[\]:,]|-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)'


def json_tokens(text: Column | str) -> Column:
    """The JSON tokens of a text that they tile completely; null of any other, as with spaces between tokens."""
    tokens = F.regexp_extract_all(_col(text), F.lit(JSON_TOKEN), F.lit(1))
    return F.when(F.array_join(tokens, "") == _col(text), tokens)


def field_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda x: x == ":"))


def cipher(text: Column | str, plain: str, coded: str) -> Column:
    """Substitute characters both ways round the alphabet, case kept; swap the arguments to decode."""
    return F.translate(_col(text), plain + plain.upper() if plain.upper() != plain else plain, coded + coded.upper() if coded.upper() != coded else coded)


def complement(matched: Column, total: Column) -> Column:
    """Ids 1..total that weren't matched."""
    return F.when(total > 0, F.array_except(F.sequence(F.lit(1), total), matched)).otherwise(F.array().cast("array<int>"))


def fact_check(payload: Column | str, total: Column) -> Column:
    """Matched fact ids of a JSON array: struct of parse_ok, facts_matched (sorted, distinct) and parse_error.

    Anything but integers from 1 to ``total`` is a parse failure, which isn't the same as nothing matched.
    """
    items = F.from_json(_col(payload), "array<string>")
    clean = F.coalesce(F.forall(items, lambda x: x.isNotNull() & x.rlike("^[0-9]{1,9}$")), F.lit(False))
    numbers = F.transform(items, lambda x: x.try_cast("int"))
    inside = F.coalesce(F.forall(numbers, lambda x: (x >= 1) & (x <= total)), F.lit(False))
    ok = items.isNotNull() & clean & inside
    error = F.when(items.isNull(), F.lit("not a JSON array")).when(~clean, F.lit("an entry is no integer")).when(~inside, F.lit("an entry is out of range"))
    return F.struct(ok.alias("parse_ok"), F.when(ok, F.array_sort(F.array_distinct(numbers))).alias("facts_matched"), error.alias("parse_error"))


def legend(entries: Column, title: str) -> Column:
    """Legend text of an array of (code, text) structs, by code."""
    lines = F.transform(F.array_sort(entries), lambda x: F.concat(x["code"], F.lit("\t"), x["text"]))
    return F.when(F.size(entries) > 0, F.concat(F.lit(f"=== {title} legend ===\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))


def loss_report(dropped: Column, derived: Column) -> Column:
    """What the register layer lost, a line for each word: its kind, the word, what stands for it, where it stood."""
    gone = F.transform(dropped, lambda x: F.struct(x["start"].alias("at"), F.format_string("dropped %s %s at %d", x["kind"], x["token"], x["start"]).alias("line")))
    short = F.transform(derived, lambda x: F.struct(x["start"].alias("at"), F.format_string("derived %s as %s at %d", x["word"], x["derived"], x["start"]).alias("line")))
    return F.transform(F.array_sort(F.concat(gone, short)), lambda x: x["line"])


def prompt(template: str, *values: Column | str) -> Column:
    """A template with %s for each value; a null value is left empty."""
    return F.format_string(template, *[F.coalesce(_col(v).cast("string"), F.lit("")) for v in values])


def usage(raw: Column | str, path: str = "$.usage") -> Column:
    """Token usage of a reply as a struct: counts must be there (an error otherwise), reasoning tokens may be."""
    number = lambda key: F.get_json_object(_col(raw), f"{path}.{key}").cast("bigint")
    required = [F.coalesce(number(k), F.raise_error(F.lit(f"usage has no {k}")).cast("bigint")).alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return F.struct(*required, number("completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"))


def inverted(mapping: Column) -> Column:
    """A map of values to keys. Values that are there twice are an error, as no map could hold both."""
    return F.map_from_arrays(F.map_values(mapping), F.map_keys(mapping))


def canonical_hash(*columns: str) -> Column:
    """First 16 hex digits of the SHA-256 of the columns as JSON with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256), 1, 16)
