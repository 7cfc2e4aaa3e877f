"""Quality rules of documents, and of the hosts they come from.

Documents fail rules one by one; of each host and rule the failures are added up, and its rate is shrunk towards what is
usual by a beta prior that is fitted to all hosts. A host whose shrunk rate is above the limit fails, and its verdict is
joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import sized_join, slices, trim, written

#: Words in a window that counts as repeated, least words, and most words in repeated windows, in percent.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Rules that are judged by host only, each with a condition on the counts of a document.
RULES = {
    "base": "base_failed",
    "symbols": "n_symbols > 0.1 * n_words",
    "lines": "n_dup_lines > 0 and 3 * n_dup_lines > n_lines",
    "long_words": "word_chars > 12 * n_words or word_chars < 2 * n_words",
}
#: A host fails a rule if more than this share of its documents is expected to.
MOST_FAILING = 0.5
#: Bounds of what a prior counts for, in documents, for the arithmetic only.
LEAST_PRIOR, MOST_PRIOR = 0.01, 1e9

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def _repeated(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many words of each of ``n`` texts lie in windows that occur twice or more there. Numbers of pairs of words, of
    pairs of pairs, and of whole windows are looked for, so nothing is hashed."""
    out = np.zeros(n, dtype=np.int64)
    if len(words) <= WINDOW:
        return out
    runs, width = words, 1
    while 2 * width <= WINDOW:  # numbers of runs of 2, 4, ... words
        runs = _ranks(runs[:-width] * (int(runs.max()) + 1) + runs[width:])
        width *= 2
    step = WINDOW - width  # two runs that overlap make the window
    whole = len(words) - WINDOW + 1
    own = owner[:whole]
    windows = _ranks(runs[:whole] * (int(runs.max()) + 1) + runs[step : step + whole]) if step else runs[:whole]
    inside = np.flatnonzero(own == owner[WINDOW - 1 :])  # windows within one text
    _, place, times = np.unique(windows[inside] * n + own[inside], return_inverse=True, return_counts=True)
    starts = inside[times[place] > 1]
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=n)


def counted(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text; null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    words = pc.ascii_split_whitespace(texts)
    flat, owner = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)  # ends of texts give empty words
    flat, owner = flat.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    lines = pc.split_pattern(texts, "\n")
    line, held = pc.list_flatten(lines), pc.list_parent_indices(lines).to_numpy()
    line, names = _codes(line)
    full = pc.match_substring_regex(names, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)[line] if len(names) else np.zeros(0, dtype=bool)
    line, held = line[full], held[full]
    first = np.unique(held * max(1, len(names)) + line) // max(1, len(names))
    n_lines = np.bincount(held, minlength=n)
    return {
        "n_words": np.bincount(owner, minlength=n), "word_chars": _sums(~_BLANK[data] & ((data & 0xC0) != 0x80), offsets), "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_lines": n_lines, "n_dup_lines": n_lines - np.bincount(first, minlength=n), "n_repeat_words": _repeated(_codes(flat)[0], owner, n),
    }


def counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``id, host``, the counts of each whole text, and ``base_failed``."""
    kinds = ", ".join(f"{c} {docs.schema[x].dataType.simpleString()}" for c, x in (("id", id_col), ("host", host_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = counted(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(found[c], pa.int64()) for c in _COUNTS]], names=["id", "host", *_COUNTS])
        trim()

    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def prior(hosts: DataFrame, failures: str) -> tuple[float, float]:
    """Mean of the beta prior of a rule's rates, and how many documents it counts for, by moments over hosts (``n``).

    The squared gaps between rates and the mean, each weighed by the host's documents, are what chance gives plus what
    sets hosts apart. Five sums come to the driver.
    """
    rate = F.col(failures) / F.col("n")
    n, k, squares, hosts_seen, second = (float(x or 0) for x in hosts.agg(F.sum("n"), F.sum(failures), F.sum(F.col("n") * F.col("n")), F.count("*"), F.sum(F.col("n") * rate * rate)).first())
    mean = (k + 0.5) / (n + 1)
    chance = mean * (1 - mean)
    gaps = second - 2 * mean * k + mean * mean * n
    apart = (gaps - hosts_seen * chance) / max(1e-9, n - squares / n) if n else 0.0
    return mean, MOST_PRIOR if apart <= 0 else min(MOST_PRIOR, max(LEAST_PRIOR, chance / apart - 1))


def verdicts(checked: DataFrame, rules: dict[str, str] = RULES, most: float = MOST_FAILING) -> DataFrame:
    """Per host: ``host`` (null is one), ``n``, for each rule ``failed_<rule>`` and ``rate_<rule>`` (shrunk), ``host_failed``."""
    failures = [F.count_if(F.expr(rule)).alias(f"failed_{name}") for name, rule in rules.items()]
    hosts = written(checked.groupBy("host").agg(F.count("*").alias("n"), *failures), "hosts")
    out, failed = hosts, F.lit(False)
    for name in rules:
        mean, strength = prior(hosts, f"failed_{name}")
        rate = (F.col(f"failed_{name}") + mean * strength) / (F.col("n") + strength)
        out = out.withColumn(f"rate_{name}", rate)
        failed = failed | (rate > most)
    return out.withColumn("host_failed", failed)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: dict[str, str] = RULES, most: float = MOST_FAILING) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, ``base_failed``, ``kept``,
    ``host_failed`` and ``n_lines`` (lines with a word).

    Kept is what passes the base rules and comes from a host that fails none of ``rules``. Null and empty texts have no
    words and fail. A null host is a host of its own; a host of few documents is judged by what is usual rather than by
    its own. Repeated rows count as often as they are there, an empty table gives none, other columns are left alone.
    Counts are added up before they are sent, and join back to documents without their texts.
    """
    checked = written(counts(docs, id_col, text_col, host_col), "counts")
    hosts = verdicts(checked, rules, most).select(F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host_key"), F.col("host").isNull().alias("no_host"), "host_failed")
    rows = checked.withColumns({"host_key": F.coalesce(F.col("host").cast("string"), F.lit("")), "no_host": F.col("host").isNull()})
    rows = sized_join(rows, hosts, ["host_key", "no_host"], "inner").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed", "n_lines")


def _rate_sql(rule: str) -> str:
    """Posterior mean of a rule's rate by host, as ``prior`` and ``verdicts`` have it."""
    return f"""
m_{rule} as (select (sum(f_{rule}) + 0.5) / (sum(n) + 1) as mean, sum(n)::double as n, sum(f_{rule})::double as k, sum(n * n)::double as squares, count(*) as hosts, sum(n * (f_{rule} / n) * (f_{rule} / n)) as second from hosts),
a_{rule} as (select mean, mean * (1 - mean) as chance, (second - 2 * mean * k + mean * mean * n - hosts * mean * (1 - mean)) / greatest(1e-9, n - squares / n) as apart from m_{rule}),
s_{rule} as (select mean, case when apart <= 0 then {MOST_PRIOR} else least({MOST_PRIOR}, greatest({LEAST_PRIOR}, chance / apart - 1)) end as strength from a_{rule}),
r_{rule} as (select source, (f_{rule} + mean * strength) / (n + strength) as rate from hosts, s_{rule})"""


RULES_SQL = (
    r"""
with d as materialized (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
u as materialized (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
g as (select doc_id, i, word || ' ' || lead(word, 1) over v || ' ' || lead(word, 2) over v || ' ' || lead(word, 3) over v || ' ' || lead(word, 4) over v as gram from u window v as (partition by doc_id order by i)),
c as (select doc_id, i, (gram is not null and count(*) over (partition by doc_id, gram) > 1)::int as again from g),
p as (select doc_id, max(again) over (partition by doc_id order by i rows between 4 preceding and current row) as hit from c),
rw as (select doc_id, sum(hit)::bigint as n_repeat_words from p group by doc_id),
l as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
dl as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
e as materialized (select doc_id, source, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines
  from d left join rw using (doc_id) left join dl using (doc_id)),
f as materialized (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from e),
hosts as materialized (select source, count(*) as n, """
    + ", ".join(f"count_if({rule}) as f_{name}" for name, rule in RULES.items())
    + " from f group by source),"
    + ",".join(_rate_sql(name) for name in RULES)
    + ",\nverdict as (select h.source, greatest("
    + ", ".join(f"(select rate from r_{name} x where x.source is not distinct from h.source)" for name in RULES)
    + f""") > {MOST_FAILING} as host_failed from hosts h)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_failed as kept, host_failed, n_lines
from f join verdict v on f.source is not distinct from v.source
"""
)
