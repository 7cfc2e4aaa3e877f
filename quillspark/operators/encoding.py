"""Dictionary encoding with a codebook that is a table: a position index of token n-grams, joined to the entries.

The codec of ``codec.Codebook`` tries every entry at every place of a text. Here a text offers what stands at its places,
and equi-joins find the entries that begin there and then those that stand there, so time hardly grows with the codebook. Of what is found, the longest entry at each place counts, and of those, from the left, each that begins where the
one before it ends or later: pointers to the next such place are followed by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import approx_count
from quillspark.sources.scratch import written

#: Words, and each other character by itself.
_WORD = r"[\p{L}\p{N}_]"
_TOKEN = rf"{_WORD}+|[^\p{{L}}\p{{N}}_]"
#: Most entries, and bytes of their texts, of a codebook that is broadcast; a larger one is joined by shuffling.
BROADCAST_ENTRIES, BROADCAST_BYTES = 300_000, 32_000_000
#: Tokens by which entries are looked for at first: two words and what is between them; by how much more in each next round.
PREFIX, STEP = 3, 3
#: Most tokens that a place takes along for later rounds; most first tokens of entries that places are filtered by.
WINDOW, FEW_OPENINGS = 243, 100


def _tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def prepared(book: DataFrame) -> DataFrame:
    """Entries as the join needs them: ``code, expansion, low, k`` (tokens), ``chars, pays``, and whether the expansion
    begins and ends with a word. Of entries with one expansion but for the case, that of the last code counts."""
    one = book.where(F.length("expansion") > 0).select("code", "expansion", F.lower("expansion").alias("low"))
    one = one.groupBy("low").agg(F.max_by(F.struct("code", "expansion"), F.struct(F.lower("code"), "code")).alias("e")).select("low", "e.*")
    return one.select(
        "code", "expansion", "low", F.size(_tokens("expansion")).alias("k"), F.length("expansion").alias("chars"), (approx_count("code") < approx_count("expansion")).alias("pays"),
        F.col("expansion").rlike(f"^{_WORD}").alias("word_first"), F.col("expansion").rlike(f"{_WORD}$").alias("word_last"),
    )


def _first(tokens: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens, 1, n), "")


def _grams(rows: DataFrame, window: int) -> DataFrame:
    """``key, at, n_tokens, gram, left, right, window``: of each place that ``begun`` lists (``i``, its place in ``t``, and ``at``, the tokens
    of the text before it) the grams of its ``lengths``, the tokens right before and after, and if ``window`` is given, for later
    rounds, that many tokens from the one before the place on."""
    longer = F.flatten(F.transform("begun", lambda b: F.transform(F.filter(b["lengths"], lambda k: b["i"] + k - 1 <= F.size("t")), lambda k: F.struct(b["i"].alias("i"), b["at"].alias("at"), k.alias("k")))))
    ahead = lambda x: F.slice("t", F.greatest(x["i"] - 1, F.lit(1)), window)
    none = F.expr("cast(null as array<string>)")
    gram = lambda x: F.struct(
        x["at"].alias("at"), x["k"].alias("n_tokens"), F.array_join(F.slice("t", x["i"], x["k"]), "").alias("gram"), F.get("t", x["i"] - 2).alias("left"), F.get("t", x["i"] + x["k"] - 1).alias("right"),
        (F.when(x["k"] == F.array_max("widest"), ahead(x)) if window else none).alias("window"),
    )
    return rows.select("key", F.inline(F.transform(longer, gram)))


def matches(texts: DataFrame, book: DataFrame) -> DataFrame:
    """What of the codebook stands in each text, the longest at each place: ``key``, and ``found``, in order, of structs of ``at``
    (tokens before it), ``k``, ``code, pays, same`` (in this very case). ``book`` is prepared.

    Places offer their first ``PREFIX`` tokens, which are joined to the beginnings of entries. Where one begins, the place
    offers grams of the lengths that such entries have up to ``STEP`` times as many tokens, and its first ``STEP`` times as
    many, by which longer entries are looked for in the next round: places without an entry drop out at once. Grams meet
    entries by their digests, so no gram is stored or shuffled as text, and a place that stays takes what later rounds need
    along, up to ``WINDOW`` tokens.
    """
    book = written(book.withColumn("u", _tokens("low")), "entries")
    digest = lambda c: F.unhex(F.md5(c))
    marks = book.select(digest("low").alias("low_digest"), "k", "chars", "code", "pays", digest("expansion").alias("digest"))
    about = book.agg(F.max("k"), F.bool_and("word_first"), F.count("*"), F.sum(F.octet_length("code")), F.bool_and(~F.col("low").rlike(r"[^\x00-\x7F]"))).first()
    longest, from_words, n, size, plain = about
    if n <= BROADCAST_ENTRIES * 4 and (size or 0) <= BROADCAST_BYTES:  # without their texts
        marks = F.broadcast(marks)
    widths = [PREFIX]
    while widths[-1] * STEP <= (longest or 0):
        widths.append(widths[-1] * STEP)

    def begin(w: int) -> DataFrame:
        """Beginnings of entries, ``w`` tokens (or all of the shortest ones), and the lengths to offer."""
        least = book if w == PREFIX else book.where(F.col("k") >= w)
        found = written(least.groupBy(_first(F.col("u"), w).alias("start")).agg(F.collect_set(F.least("k", F.lit(w * STEP))).alias("lengths")), "beginnings")
        count, size = found.agg(F.count("*"), F.sum(F.octet_length("start"))).first()
        return F.broadcast(found) if count <= BROADCAST_ENTRIES and (size or 0) <= BROADCAST_BYTES else found

    split = texts.select("key", _tokens("text").alias("t")).withColumn("n", F.size("t"))
    places = lambda p: F.sequence(F.lit(1), F.col("n") - p + 1)
    some = (lambda p: F.filter(places(p), lambda i: F.element_at("t", i) != " ")) if from_words else places
    opening = [r[0] for r in book.select(F.element_at("u", 1)).distinct().limit(FEW_OPENINGS + 1).collect()]
    if plain and len(opening) <= FEW_OPENINGS:  # few places are spelt out then; other letters' lower case may depend on what follows
        some = lambda p: F.filter(places(p), lambda i: F.lower(F.element_at("t", i)).isin(opening))

    def starts(p: int) -> Column:
        return F.when(F.col("n") >= p, F.transform(some(p), lambda i: F.struct(i.alias("i"), F.lower(F.array_join(F.slice("t", i, p), "")).alias("start"))))

    none = "cast(array() as array<struct<i:int,start:string>>)"
    shorter = [r[0] for r in book.where(F.col("k") < PREFIX).select("k").distinct().collect()]  # below PREFIX
    index = split.select("key", F.inline(F.flatten(F.array_compact(F.array(F.expr(none), *map(starts, [PREFIX, *shorter]))))))
    begun = written(index.join(begin(PREFIX), "start").select("key", (F.col("i") - 1).alias("at"), "lengths"), "begun")
    word = lambda c: F.coalesce(F.col(c).rlike(f"^{_WORD}"), F.lit(False))
    hits, window = [], min(longest or 0, WINDOW) + 2
    for w, after in zip(widths, [*widths[1:], None], strict=True):
        if w == PREFIX or w * STEP + 2 > window and window < (longest or 0) + 2:
            lists = begun.groupBy("key").agg(F.collect_list(F.struct((F.col("at") + 1).alias("i"), "at", "lengths")).alias("begun"))
            rows = texts.join(lists, "key").withColumn("t", _tokens("text"))
        else:
            place = F.struct(F.when(F.col("at") == 0, 1).otherwise(2).alias("i"), "at", "lengths")
            rows = begun.select("key", F.col("window").alias("t"), F.array(place).alias("begun"))
        grams = _grams(rows.withColumn("widest", F.array(F.lit(after or 0))), window if after else 0)
        whole = ~word("left") & ~word("right")  # words are whole by their tokens; a sign at an edge may not touch one
        grams = grams.withColumns({"low_digest": digest(F.lower("gram")), "own": digest("gram")})
        seen = grams.join(marks, (grams["low_digest"] == marks["low_digest"]) & (F.col("n_tokens") == F.col("k")), "left")
        kept = ["key", "at", "k", "chars", "code", "pays", (F.col("own") == F.col("digest")).alias("same"), (F.col("k").isNotNull() & whole).alias("hit")]
        if after:
            probe = F.when(F.col("n_tokens") == after, F.lower("gram"))
            ahead = begin(after)
            seen = seen.withColumn("start", probe).join(ahead, "start", "left")
            seen = written(seen.select(*kept, "lengths", F.when(F.col("lengths").isNotNull(), F.col("window")).alias("window")).where("hit or lengths is not null"), "seen")
            begun = seen.where("lengths is not null").select("key", "at", "lengths", "window")
        else:
            seen = seen.select(*kept)
        hits.append(seen.where("hit").select("key", "at", "k", "chars", "code", "pays", "same"))
    hit = hits[0]
    for more in hits[1:]:
        hit = hit.unionByName(more)
    best = hit.groupBy("key", "at").agg(F.max_by(F.struct("at", "k", "code", "pays", "same"), F.struct("chars", F.col("k"))).alias("m"))
    return best.groupBy("key").agg(F.array_sort(F.collect_list("m")).alias("found"))


def _at_bit(f, b: int):
    return lambda p, c: f(p, c, b)


def leftmost(found: DataFrame) -> DataFrame:
    """Keep of ``found`` what is taken from the left without overlaps.

    Of each place, the next one is the first that begins at its end or later. Its pointers are doubled: after b rounds they
    lead 2 ** b places on, and the c-th place that is taken is where the pointers for the bits of c lead. So a text of m
    places takes about log m rounds over m pointers, and no row of a chain waits for the one before it.
    """
    sizes = found.agg(F.max(F.size("found")), F.max(F.array_max(F.transform("found", lambda m: m["k"])))).first()
    rounds, longest = (sizes[0] or 0).bit_length(), sizes[1] or 1
    end = F.size("found") + 1  # past the last place: leads to itself

    def ahead(i: Column) -> Column:
        """Pointer of the i-th place. No more than ``longest`` places can begin within it."""
        own = F.element_at("found", i)
        return i + 1 + F.size(F.filter(F.slice("found", i + 1, longest), lambda x: x["at"] < own["at"] + own["k"]))

    def led(p: Column, c: Column, b: int) -> Column:
        return F.when(F.shiftright(c, b).bitwiseAND(1) == 1, F.element_at("jump", p)).otherwise(p)

    rows = found.withColumn("jump", F.concat(F.transform(F.sequence(F.lit(1), F.size("found")), lambda i: ahead(i)), F.array(end)))
    rows = rows.withColumn("taken", F.transform("found", lambda _: F.lit(1)))
    for b in range(rounds):
        rows = rows.withColumn("taken", F.transform("taken", _at_bit(led, b)))
        if b + 1 < rounds:
            rows = rows.withColumn("jump", F.transform("jump", lambda p: F.element_at("jump", p)))
    taken = F.filter("taken", lambda p: p < end)
    return rows.select("key", F.transform(taken, lambda p: F.element_at("found", p)).alias("found"))


def dictionary_encoded(docs: DataFrame, book: DataFrame, text: str = "text", name: str = "coded") -> DataFrame:
    """``docs`` with ``name``: a struct of ``coded`` (text), ``applied`` (array of code, expansion, start, end) and ``skipped`` (of code,
    expansion), as ``codec.dictionary_encoder`` gives them.

    ``book`` has ``code`` and ``expansion``. Entries are found as whole words whatever their case, the longest first; one in
    another case, or whose code costs no less than it, stays as it is and still uses up its span. Each distinct text is
    encoded once. A null text gives null parts; an empty codebook changes nothing. Letters that
    change their length with their case are compared in lower case, character by character.
    """
    entries = written(prepared(book), "book")
    keyed = docs.withColumn("_key", F.md5(text))
    texts = keyed.where(F.col(text).isNotNull()).select(F.col("_key").alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    texts = written(texts, "texts")  # read in each round of the search, and at last
    chosen = leftmost(written(matches(texts, entries), "matches"))
    whole = texts.join(chosen, "key", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<at:int,k:int,code:string,pays:boolean,same:boolean>>)")))
    whole = whole.withColumn("t", _tokens("text"))
    until = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.element_at("found", j)["at"] + F.element_at("found", j)["k"])  # noqa: E731  end of the one before
    gap = lambda m, j: F.array_join(F.slice("t", until(j) + 1, m["at"] - until(j)), "")
    pieces = F.transform("found", lambda m, j: F.struct(gap(m, j).alias("gap"), F.array_join(F.slice("t", m["at"] + 1, m["k"]), "").alias("own"), (m["pays"] & m["same"]).alias("use"), m["code"].alias("code"), m["same"].alias("same")))
    whole = whole.withColumn("p", pieces)
    rest = F.when(F.size("found") > 0, F.element_at("found", -1)["at"] + F.element_at("found", -1)["k"]).otherwise(F.lit(0))
    last = F.array_join(F.slice("t", rest + 1, F.size("t")), "")
    coded = F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["gap"], F.when(x["use"], x["code"]).otherwise(x["own"]))), ""), last)
    spans = F.transform("p", lambda x: F.struct(x["code"].alias("code"), x["own"].alias("own"), x["use"].alias("use"), F.length(x["gap"]).alias("gap"), F.length(x["own"]).alias("chars")))
    skipped = F.transform(F.filter("p", lambda x: x["same"] & ~x["use"]), lambda x: F.struct(x["code"].alias("code"), x["own"].alias("expansion")))
    parts = whole.select("key", coded.alias("coded"), skipped.alias("skipped"), spans.alias("spans"))
    upto = Window.partitionBy("key").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    each = parts.select("key", "coded", "skipped", F.posexplode_outer("spans").alias("j", "s"))
    head = F.coalesce("j", F.lit(0)) == 0  # the text's own columns go with its first row
    each = each.select("key", "j", "s", F.when(head, F.col("coded")).alias("coded"), F.when(head, F.col("skipped")).alias("skipped"))
    each = each.withColumn("end", F.sum(F.col("s.gap") + F.col("s.chars")).over(upto).cast("int"))
    span = F.struct(F.col("s.code").alias("code"), F.col("s.own").alias("expansion"), (F.col("end") - F.col("s.chars")).alias("start"), F.col("end").alias("end"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("s.use"), F.struct(F.col("j"), span.alias("span")))))
    done = each.groupBy("key").agg(F.first("coded", ignorenulls=True).alias("coded"), F.transform(ordered, lambda x: x["span"]).alias("applied"), F.first("skipped", ignorenulls=True).alias("skipped"))
    done = done.select(F.col("key").alias("_key"), F.struct("coded", "applied", "skipped").alias(name))
    empty = F.struct(F.lit(None).cast("string").alias("coded"), F.lit(None).cast(done.schema[name].dataType["applied"].dataType).alias("applied"), F.lit(None).cast(done.schema[name].dataType["skipped"].dataType).alias("skipped"))
    return keyed.join(done, "_key", "left").withColumn(name, F.coalesce(name, empty)).drop("_key")
