"""Codebook and register codecs, the character cipher, and frame dictionaries.

Encoders that must report offsets run as Arrow-batched pandas functions; the cipher is a built-in expression. Codebooks
are small by nature and travel with the function.
"""

from __future__ import annotations

import difflib
import random
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import text as text_functions

_TOKEN = re.compile(r"[A-Za-z0-9]{1,4}|[^A-Za-z0-9\s]")


#: Signs that aren't a part of the word that they stand beside, and what looks like a code.
AROUND_WORDS, LIKE_A_CODE = ".,;:!?\"'()[]", re.compile(r"[A-Z]{2,5}|\d{2,3}")


def token_cost(text: str) -> int:
    """``approx_count`` of one string."""
    return len(_TOKEN.findall(text))


@dataclass(frozen=True)
class Entry:
    code: str
    expansion: str
    case_sensitive: bool = True
    table: str = ""


@dataclass(frozen=True)
class Rules:
    """What the register codec drops and shortens."""

    articles: tuple[str, ...] = ("a", "an", "the")
    copulas: tuple[str, ...] = ("is", "are", "was", "were")
    verb_words: tuple[str, ...] = ()
    verb_endings: tuple[str, ...] = ("ing", "ed")
    derivations: dict[str, str] = field(default_factory=dict)


def _whole_words(parts: Iterable[str], flags: int = 0) -> re.Pattern | None:
    body = "|".join(rf"(?<!\w){re.escape(p)}(?!\w)" for p in parts)
    return re.compile(body, flags) if body else None


class Codebook:
    """Encoder and decoder of one set of entries; longest expansions and codes go first."""

    def __init__(self, entries: Iterable[Entry]):
        self.entries = sorted(entries, key=lambda e: (-len(e.expansion), e.expansion.casefold(), e.code.casefold()))
        self.by_expansion = {e.expansion.casefold(): e for e in self.entries}
        self.find = _whole_words((e.expansion for e in self.entries), re.IGNORECASE)
        codes = sorted(self.entries, key=lambda e: (-len(e.code), e.code.casefold()))
        self.by_code = {e.code: e for e in reversed(codes)}
        self.find_code = _whole_words(e.code for e in codes)
        self.known = {x.casefold() for e in self.entries for x in (e.code, e.expansion)}

    def encode(self, text: str) -> tuple[str, list[tuple[str, str, int, int]], list[tuple[str, str]]]:
        """Coded text, what was applied (code, expansion, start, end) and what would not have paid (code, expansion).

        A match in another case, or one that doesn't pay, stays as it is and still uses up its span.
        """
        applied: list[tuple[str, str, int, int]] = []
        skipped: list[tuple[str, str]] = []

        def put(m: re.Match) -> str:
            e = self.by_expansion[m[0].casefold()]
            if m[0] != e.expansion:
                return m[0]
            if token_cost(e.code) >= token_cost(e.expansion):
                skipped.append((e.code, e.expansion))
                return m[0]
            applied.append((e.code, e.expansion, *m.span()))
            return e.code

        return (self.find.sub(put, text) if self.find else text), applied, skipped

    def decode(self, text: str) -> tuple[str, list[str]]:
        """Decoded text, and the words in it that look like codes but are in no table."""
        out = self.find_code.sub(lambda m: self.by_code[m[0]].expansion, text) if self.find_code else text
        bare = (w.strip(AROUND_WORDS) for w in out.split()) if self.entries else ()
        return out, [w for w in bare if LIKE_A_CODE.fullmatch(w) and w.casefold() not in self.known]


class Register:
    """What becomes of a word, by the word itself and the one after it: a table of words that go, each with the condition
    on which it stays, and a table of shorter forms, those that pay."""

    def __init__(self, rules: Rules):
        self.kinds = {w.casefold(): kind for kind, group in (("copula", rules.copulas), ("article", rules.articles)) for w in group}
        self.verbs, self.endings = frozenset(rules.verb_words), tuple(rules.verb_endings)
        shorter = {w.casefold(): d for w, d in rules.derivations.items()}
        self.shorter = {w: (d, token_cost(d)) for w, d in shorter.items()}

    def stays(self, kind: str, after: str | None) -> bool:
        """A copula does at the end of a text and before what looks like a verb; an article never does."""
        return kind == "copula" and (after is None or after in self.verbs or after.endswith(self.endings))

    def change(self, word: str, after: str | None) -> tuple[str, str] | None:
        """Kind of the change and what stands in the word's place, if any. Words go in lower case only."""
        if kind := self.kinds.get(word):
            return None if self.stays(kind, after) else (kind, "")
        short, cost = self.shorter.get(word.casefold(), (None, 0))
        return ("derived", short) if short is not None and cost < token_cost(word) else None


def encode_register(text: str, rules: Rules) -> tuple[str, list[tuple[str, str, int, int]], list[tuple[str, str, int, int]]]:
    """Shortened text, dropped words (token, kind, start, end) and derived ones (from, to, start, end). Runs of blanks
    become one."""
    register = Register(rules)
    words = list(re.finditer(r"\w+", text))
    following = [m[0].casefold() for m in words[1:]] + [None]
    changes = [(m, change) for m, after in zip(words, following, strict=False) if (change := register.change(m[0], after))]
    cuts = [0, *(edge for m, _ in changes for edge in m.span()), len(text)]
    kept = [text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    short = "".join(part for pair in zip(kept, [*(new for _, (_, new) in changes), ""], strict=True) for part in pair)
    dropped = [(m[0], kind, *m.span()) for m, (kind, _) in changes if kind != "derived"]
    derived = [(m[0], new, *m.span()) for m, (kind, new) in changes if kind == "derived"]
    return re.sub(r"[ \t]{2,}", " ", short), dropped, derived


_APPLIED = "array<struct<code:string,expansion:string,start:int,end:int>>"
_SKIPPED = "array<struct<code:string,expansion:string>>"
_DROPPED = "array<struct<token:string,kind:string,start:int,end:int>>"
_DERIVED = "array<struct<word:string,derived:string,start:int,end:int>>"


def _records(rows: list[tuple], names: str) -> list[dict]:
    keys = names.split()
    return [dict(zip(keys, r, strict=True)) for r in rows]


def dictionary_encoder(entries: Iterable[Entry]) -> Callable[[Column], Column]:
    """A function of a text column: struct coded, applied, skipped. Null gives null parts."""
    book = Codebook(entries)

    @F.pandas_udf(f"coded string, applied {_APPLIED}, skipped {_SKIPPED}")
    def encode(text: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None else book.encode(t) for t in text]
        return pd.DataFrame({"coded": [r[0] for r in rows], "applied": [None if r[1] is None else _records(r[1], "code expansion start end") for r in rows], "skipped": [None if r[2] is None else _records(r[2], "code expansion") for r in rows]})

    return encode


def dictionary_decoder(entries: Iterable[Entry]) -> Callable[[Column], Column]:
    """A function of a coded column: struct text, unknown_codes. An unknown code is a finding, not an exception."""
    book = Codebook(entries)

    @F.pandas_udf("text string, unknown_codes array<string>")
    def decode(coded: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else book.decode(t) for t in coded], columns=["text", "unknown_codes"])

    return decode


def restored_text(coded: str, applied: Iterable[tuple[str, str, int]]) -> str | None:
    """The text that ``coded`` was made of, by what was applied (code, expansion, start in the text): codes that the text had
    before stay. Null if a code doesn't stand where it was put."""
    parts, at, done = [], 0, 0  # places in the coded and in the plain text
    for code, expansion, start in applied:
        upto = at + start - done
        if coded[upto : upto + len(code)] != code:
            return None
        parts += [coded[at:upto], expansion]
        at, done = upto + len(code), start + len(expansion)
    return "".join([*parts, coded[at:]])


@F.pandas_udf(StringType())
def _restored(coded: pd.Series, codes: pd.Series, expansions: pd.Series, starts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else restored_text(t, zip(c, e, s, strict=True)) for t, c, e, s in zip(coded, codes, expansions, starts, strict=True)], dtype=object)


def dictionary_restored(encoded: Column) -> Column:
    """The text that ``dictionary_encoder`` made ``encoded`` of, whatever stands in it. Decoding by the codebook alone can't tell
    a code from the same word in the text."""
    part = lambda name: F.transform(encoded["applied"], lambda a: a[name])
    return _restored(encoded["coded"], part("code"), part("expansion"), part("start"))


def register_encoder(rules: Rules) -> Callable[[Column], Column]:
    """A function of a text column: struct coded, dropped, derived, lossy."""

    @F.pandas_udf(f"coded string, dropped {_DROPPED}, derived {_DERIVED}, lossy boolean")
    def encode(text: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None else encode_register(t, rules) for t in text]
        return pd.DataFrame({
            "coded": [r[0] for r in rows], "dropped": [None if r[1] is None else _records(r[1], "token kind start end") for r in rows],
            "derived": [None if r[2] is None else _records(r[2], "word derived start end") for r in rows], "lossy": [None if r[1] is None else bool(r[1]) for r in rows],
        })

    return encode


def router_encoder(entries: Iterable[Entry], rules: Rules) -> Callable[[Column], Column]:
    """Dictionary layer, then register layer: struct version, original, coded, dictionary, register."""
    book = Codebook(entries)

    @F.pandas_udf(f"first string, applied {_APPLIED}, skipped {_SKIPPED}, coded string, dropped {_DROPPED}, derived {_DERIVED}")
    def layers(text: pd.Series) -> pd.DataFrame:
        """Both in one pass through one Python worker."""
        rows = []
        for t in text:
            first, applied, skipped = (None, None, None) if t is None else book.encode(t)
            coded, dropped, derived = (None, None, None) if t is None else encode_register(first, rules)
            parts = ((applied, "code expansion start end"), (skipped, "code expansion"), (dropped, "token kind start end"), (derived, "word derived start end"))
            applied, skipped, dropped, derived = (None if part is None else _records(part, names) for part, names in parts)
            rows.append((first, applied, skipped, coded, dropped, derived))
        return pd.DataFrame(rows, columns=["first", "applied", "skipped", "coded", "dropped", "derived"])

    def encode(text: Column) -> Column:
        done = layers(text)
        first = F.struct(done["first"].alias("coded"), done["applied"].alias("applied"), done["skipped"].alias("skipped"))
        second = F.struct(done["coded"].alias("coded"), done["dropped"].alias("dropped"), done["derived"].alias("derived"), (F.size(done["dropped"]) > 0).alias("lossy"))
        return F.struct(F.lit(1).alias("version"), text.alias("original"), done["coded"].alias("coded"), first.alias("dictionary"), second.alias("register"))

    return encode


def loss_summary(dropped: Column, derived: Column) -> Column:
    """One line about what the register layer lost."""
    kind = lambda k: F.size(F.filter(dropped, lambda x: x["kind"] == k))
    return F.format_string("articles dropped: %d; copulas dropped: %d; words derived: %d; lossy: %s", kind("article"), kind("copula"), F.size(derived), F.size(dropped) > 0)


def verify(text: str, entries: Iterable[Entry], rules: Rules, strict: bool = False) -> tuple[int, str]:
    """Status and message: 0 the dictionary layer comes back, 1 it doesn't (or, strictly, a substitution didn't pay),
    2 a word looks like an unknown code."""
    book = Codebook(entries)
    coded, _, skipped = book.encode(text)
    back, unknown = book.decode(coded)
    if unknown:
        return 2, f"unknown code {unknown[0]!r}"
    if back != text:
        lines = list(difflib.unified_diff(text.splitlines() or [text], back.splitlines() or [back], lineterm="", n=0))
        return 1, "\n".join(lines[:12])
    if strict and skipped:
        return 1, "didn't pay: " + ", ".join(f"{e}->{c}" for c, e in skipped)
    _, dropped, derived = encode_register(text, rules)
    return 0, f"round trip holds; {len(dropped)} words dropped, {len(derived)} derived"


def verifier(entries: Iterable[Entry], rules: Rules, strict: bool = False) -> Callable[[Column], Column]:
    """``verify`` as a function of a column: struct status, message."""
    entries = tuple(entries)

    @F.pandas_udf("status int, message string")
    def check(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else verify(t, entries, rules, strict) for t in text], columns=["status", "message"])

    return check


def derangement(alphabet: str, seed: int) -> str:
    """A seeded permutation of an alphabet that moves every character."""
    rng = random.Random(seed)
    if len(set(alphabet)) < 2:
        raise ValueError("an alphabet of one can't be deranged")
    letters = list(alphabet)
    while any(a == b for a, b in zip(letters, alphabet, strict=True)):
        rng.shuffle(letters)
    return "".join(letters)


def cipher_tables(seed: int = 21) -> tuple[str, str]:
    """Plain and coded alphabets for ``functions.text.cipher``."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return letters + digits, derangement(letters, seed) + derangement(digits, seed)


def cipher_encode(text: Column | str, tables: tuple[str, str]) -> Column:
    plain, coded = tables
    return text_functions.cipher(text, plain, coded)


def cipher_decode(text: Column | str, tables: tuple[str, str]) -> Column:
    plain, coded = tables
    return text_functions.cipher(text, coded, plain)


def frame_codec(frame_codes: dict[str, str], segment_codes: dict[str, str]) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Encoder and decoder of frames: a code of the whole frame, else of the leftmost, longest segments in it."""
    segments = re.compile("|".join(map(re.escape, sorted(segment_codes, key=lambda s: (-len(s), s))))) if segment_codes else None
    back = {c: t for codes in (segment_codes, frame_codes) for t, c in codes.items()}
    codes = re.compile("|".join(map(re.escape, sorted(back, key=lambda c: (-len(c), c))))) if back else None

    @F.pandas_udf("string")
    def encode(text: pd.Series) -> pd.Series:
        one = lambda t: frame_codes[t] if t in frame_codes else segments.sub(lambda m: segment_codes[m[0]], t) if segments else t
        return pd.Series([None if t is None else one(t) for t in text], dtype=object)

    @F.pandas_udf("string")
    def decode(coded: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else codes.sub(lambda m: back[m[0]], t) if codes else t for t in coded], dtype=object)

    return encode, decode


def invalid_codes(codes: Iterable[str]) -> list[str]:
    """What is wrong with a set of codes: repeats, other than ASCII letters and digits, one the beginning of another."""
    codes = sorted(codes)
    found = [f"{c!r} has other than ASCII letters and digits" for c in set(codes) if not (c.isascii() and c.isalnum())]
    for a, b in zip(codes, codes[1:], strict=False):
        if a == b:
            found.append(f"{a!r} is there twice")
        elif b.startswith(a):
            found.append(f"{a!r} begins {b!r}")
    return sorted(found)
