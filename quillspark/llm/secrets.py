"""Secret scans by assignment-aware lexing.

Source, configuration and markup are lexed into pairs of a name and the literals of its value: assignments of any sign,
keyword and named arguments, elements and attributes, fields that name the next one, strings over several lines, blocks
of deeper lines. Constants propagate within their function and from outside it, also from below their use.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm._shared import slices

KINDS = ("assign", "access", "hex", "pair")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: How source, configuration and markup give a value to a name: ``name = value`` with a bare, dotted or quoted name and
#: any assignment sign, a call with the name as its first argument, an element of that name.
_START = re.compile(
    r"""(?<![\w.$-])(?P<typed>[A-Za-z_][A-Za-z0-9_.]*+)[ \t]*:[ \t]*(?:&(?:'static[ \t]+)?)?(?:str|string|bytes|String|Text|SecretStr|Any|(?:Optional|Final|ClassVar)(?:\[[^][\n]*+\])?)(?:[ \t]*\|[ \t]*None)?[ \t]*=(?![=~>])[ \t]*"""
    r"""|^[ \t]*(?:(?:let|const|var|my)[ \t]+)?(?P<many>[A-Za-z_]\w*+(?:[ \t]*,[ \t]*[A-Za-z_]\w*+)++)[ \t]*=(?![=~>])[ \t]*"""
    r"""|\[[ \t]*(?P<edge>["'])(?P<index>[A-Za-z_][A-Za-z0-9_.-]*+)(?P=edge)[ \t]*\][ \t]*:?=(?![=~>])[ \t]*"""
    r"""|(?<![\w.$-])(?P<quote>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)(?P=quote)[ \t]*(?::=|=>|=|:)(?![=:/~])[ \t]*"""
    r"""|^[ \t]*(?:ENV|ARG|setenv)[ \t]+(?P<env>[A-Za-z_]\w*+)[ \t]+(?!=)"""
    r"""|\([ \t]*(?P<mark>["'])(?P<argument>[A-Za-z_][A-Za-z0-9_.-]*+)(?P=mark)[ \t]*,[ \t]*"""
    r"""|<(?P<element>[A-Za-z_][A-Za-z0-9_.-]*+)(?:[ \t][^<>]*+)?>(?P<body>[^<>]++)(?=</(?P=element)[ \t]*>)""",
    re.ASCII | re.MULTILINE,
)
_STRING = re.compile(
    r'"""((?:[^"\\]|\\.|"(?!""))*+)"""' + r"|'''((?:[^'\\]|\\.|'(?!''))*+)'''" + r'|"((?:[^"\\\n]|\\.)*)"' + r"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`", re.DOTALL
)
#: Quotes within which names aren't inserted.
_PLAIN = (2, 4)
_BARE = re.compile(r"[A-Za-z0-9+/_.=$@!%^&*~{}-]+")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*", re.ASCII)
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.|&)[ \t]*")
_INSERT = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)")
#: Names that are inserted into a string with f before it.
_INSERT_F = re.compile(r"\{([A-Za-z_][A-Za-z0-9_.]*)(?:![rsa])?(?::[^{}]*)?\}")
_PREFIX = re.compile(r"(?:[rRbBuU]{0,2}[fF][rR]?|[rRbBuU]{1,2})(?=[\"'])")
#: What leads from one value to another that may stand in its place: the second branch of a condition, a default.
_ELSE = re.compile(r"[ \t]*(?:if\b[^\n]*?\belse\b|:|\bor\b|\|\||\?\?)[ \t]*(?=[\"'`])")
_CALLED = re.compile(r"[A-Za-z_$][\w.$]*+(?:\([^()\n]*+\)|\[[^][\n]*+\])*+[ \t]*(?:\?[ \t]*|\bor\b[ \t]*|\|\|[ \t]*|\?\?[ \t]*)(?=[\"'`])")
_PERCENT = re.compile(r"[ \t]*%[ \t]*\(?[ \t]*([A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*)")
_JOIN = re.compile(r"\.join\([ \t]*[\[(]")
_OPEN, _NEXT, _CLOSE = re.compile(r"[\[(\s]+(?=[\"'`])"), re.compile(r"[ \t]*,\s*(?=[\"'`])|\s+(?=[\"'`])"), re.compile(r"[\s,]*[\])]")
_SCHEME = re.compile(r"(?:Bearer|Basic|Token)[ \t]+(?=[A-Za-z0-9+/_.=-]{6})")
#: Whom a URL lets in: the password between its name and its host.
_URL = re.compile(r"://[^\s/:@\"'<>]*+:([^\s/@\"'<>]+)@")
#: Bare words that are names: of names with dots, or of words alone, with a number behind at most.
_DOTTED, _NAME = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+"), re.compile(r"[A-Za-z_]+[0-9]{0,2}")
#: Keys that say nothing of their own: the key of what holds them counts.
_HOLDERS = re.compile(r"[\"']?([A-Za-z_][A-Za-z0-9_-]*)[\"']?[ \t]*[:=][ \t]*\{")
_PLAIN_KEYS = ("value", "Value", "data", "content", "default", "text", "val", "string")
#: A block of deeper lines that follows a name, with its indicators.
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*\n")
_LINE = re.compile(r"([ \t]*)([^\n]*)(\n|\Z)")
_INDENT = re.compile(r"[ \t]*(?:-[ \t]+)*")
#: Names of fields that give a name to the value of the next field, as ``name: X`` and ``value: Y``.
_NAMING, _VALUE = ("name", "key", "Name", "Key"), ("value", "Value")
#: Beginnings of functions: by indentation, with their parameters; by braces.
_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+\w+[ \t]*\(([^()]*+)\)", re.ASCII | re.MULTILINE)
_FUNCTION = re.compile(r"\b(?!(?:if|for|while|switch|catch|with|return)\b)[A-Za-z_]\w*[ \t]*\(([^(){};]*+)\)[^(){};\n]*+\{", re.ASCII)
_BRACES = re.compile(r""""(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[{}]""")
_PARAMETER = re.compile(r"(?<![\w.])([A-Za-z_]\w*)(?=[ \t]*(?:[,:=]|$))", re.ASCII)
_CASES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Longest value that is copied where its name is used, and signs kept of both ends of a longer one.
COPIED, ENDS = 4096, 64

#: How far a word of a target's name makes its value a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.8, "private": 0.5, "access": 0.4, "api": 0.4, "key": 0.5, "signing": 0.5, "salt": 0.5, "pin": 0.4,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\{.*\}|\$.*|your.*|change.?me.*|example.*|dummy.*|test|todo|none|null|nil|true|false|undefined|redacted.*|placeholder.*|password|secret|token)$")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    name: str
    score: float


def base_spans(text: str) -> list[Span]:
    out = []
    if "=" in text or ":" in text:
        out += [Span("assign", *m.span(), m[1].lower(), 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span("access", *m.span(), "", 1.0) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [Span("hex", *m.span(), "", 1.0) for m in _HEX.finditer(text)]


def name_score(name: str) -> float:
    """0 to 1: chance that none of the name's words makes it sensitive, from one."""
    words = [w.lower() for part in re.split(r"[._-]", name) for w in _CASES.findall(part)]
    words = [w if w in SENSITIVE or w[-1:] != "s" else w[:-1] for w in words]  # several of them
    words += [a + b for a, b in zip(words, words[1:], strict=False)]
    return 1 - math.prod(1 - SENSITIVE.get(w, 0.0) for w in set(words))


class Long(NamedTuple):
    """What scores need of a value too long to copy at each use: values built of names can double with each line."""

    n: int
    counts: Counter
    head: str
    tail: str
    url: bool  # holds ://
    inner: bool  # a space between other signs
    lead: bool  # a space before all other signs
    trail: bool  # a space after them
    blank: bool  # white space only


#: Targets whose values may be of several words.
_PHRASE = re.compile(r"(?i)(?:password|passphrase|passwd|pass_?phrase)s?$")


def _long(x: str | Long) -> Long:
    if isinstance(x, Long):
        return x
    inside = x.strip()
    lead, trail = x[: len(x) - len(x.lstrip())], x[len(x.rstrip()) :]
    return Long(len(x), Counter(x), x[:ENDS], x[-ENDS:], "://" in x, " " in inside, " " in lead, " " in trail, not inside)


def _joined(a: Long, b: Long) -> Long:
    head, tail = (a.head + b.head)[:ENDS] if a.n < ENDS else a.head, (a.tail + b.tail)[-ENDS:] if b.n < ENDS else b.tail
    inner = a.inner or b.inner or not (a.blank or b.blank) and (a.trail or b.lead)
    lead, trail = a.lead or a.blank and b.lead, b.trail or b.blank and a.trail
    return Long(a.n + b.n, a.counts + b.counts, head, tail, a.url or b.url or "://" in a.tail[-2:] + b.head[:2], inner, lead, trail, a.blank and b.blank)


def _value(parts: list[str | Long]) -> str | Long:
    """The parts as one: a string if it is short, else what scores need of it, over its whole length."""
    if all(isinstance(x, str) for x in parts) and sum(map(len, parts)) <= COPIED:
        return "".join(parts)
    return functools.reduce(_joined, map(_long, parts))


def literal_score(value: str | Long, phrase: bool = False) -> float:
    """0 to 1: how much a value looks like generated material rather than a word, a path or a placeholder. Values of several
    words count where a phrase is expected."""
    if phrase and isinstance(value, str) and " " in value.strip():
        words = value.split()
        return 0.7 if 3 <= len(words) <= 12 and not PLACEHOLDERS.match(value) and value.strip()[-1].isalnum() and value[:1].isalnum() and not value[:1].isupper() else 0.0
    if isinstance(value, Long):
        # a placeholder longer than both ends shows in them and in the signs there are
        n, counts, shape, plain = value.n, value.counts, value.head + "".join(value.counts) + value.tail, value.url or value.inner
    else:
        n, counts, shape, plain = len(value), Counter(value), value, "://" in value or " " in value.strip()
    if n < 6 or PLACEHOLDERS.match(shape) or plain:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n)
    classes = sum(any(test(c) for c in counts) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    return min(1.0, entropy / 4) * (0.4 + 0.3 * min(2, classes - 1)) * min(1.0, 0.5 + min(n, 24) / 24)


class Source(NamedTuple):
    """Where a value comes from: places of its own literals, and the sources of the names in it."""

    places: list[tuple[int, int]]
    names: list[Source]


def _scopes(text: str) -> list[tuple[int, int, frozenset[str]]]:
    """Begin, end and parameters of each function, by begin: lines deeper than a ``def``, or what braces hold."""
    found = []
    if "def " in text:
        for m in _DEF.finditer(text):
            indent, at = len(m[1].expandtabs()), text.find("\n", m.end())
            while at >= 0 and at + 1 < len(text):
                line = _LINE.match(text, at + 1)
                if line[2] and len(line[1].expandtabs()) <= indent:
                    break
                at = line.end() - 1 if line[3] else -1
            found.append((m.start(), at if at >= 0 else len(text), frozenset(_PARAMETER.findall(m[2]))))
    if "{" in text and ")" in text and (functions := list(_FUNCTION.finditer(text))):
        open_, closes = [], {}
        for m in _BRACES.finditer(text):
            if m[0] == "{":
                open_.append(m.start())
            elif m[0] == "}" and open_:
                closes[open_.pop()] = m.start()
        found += [(m.start(), closes.get(m.end() - 1, len(text)), frozenset(_PARAMETER.findall(m[1]))) for m in functions]
    return sorted(found, key=lambda x: (x[0], -x[1]))


class _Pair(NamedTuple):
    name: str
    parts: list[str | Long]
    source: Source
    waiting: list[tuple[int, str, tuple[int, int]]]  # of the parts: place, name that isn't known yet, its own span
    scopes: tuple[int, ...]  # from the outermost one


def _block(text: str, at: int, line: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of the lines from ``at`` that are deeper than the one that begins at ``line``, and the end of the last."""
    least, spans = len(_INDENT.match(text, line)[0]), []
    while at < len(text):
        m = _LINE.match(text, at)
        if m[2].strip() and len(m[1]) <= least:
            break
        if m[2].strip():
            spans.append((m.start(2), m.start(2) + len(m[2].rstrip())))
        at = m.end()
    return spans, at


#: A name as a value, quoted or not.
_TOLD = re.compile(r"[\"']?([A-Za-z_][A-Za-z0-9_.-]*)")

#: Beginning of a line of configuration whose value follows at once.
_CONFIG = re.compile(r"[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]*)?[A-Za-z_][A-Za-z0-9_.-]*=$")


def _holders(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and key of what braces hold, where a key with a value of no telling name may stand."""
    if "{" not in text or not any(x in text for x in _PLAIN_KEYS) or not (opens := {m.end() - 1: m[1] for m in _HOLDERS.finditer(text)}):
        return []
    out, stack = [], []
    for m in _BRACES.finditer(text):
        if m[0] == "{":
            stack.append(m.start())
        elif m[0] == "}" and stack and (start := stack.pop()) in opens:
            out.append((start, m.start(), opens[start]))
    return sorted(out)


def pairs(text: str) -> Iterator[tuple[str, str | Long, Source]]:
    """Name, value and source of each assignment, in order.

    A value is a chain of string literals, bare words and names joined by a concatenation sign, a block of deeper
    lines, the text of an element, or literals in brackets. A condition and a default give several values. A bare word
    is a literal only if it can't be a name: names with dots, calls and subscripts never are. A name stands for its value at that place, or else for the first one that it gets
    later on (constants propagate, also into ``$name`` and ``${name}``); what is assigned within a function isn't known
    outside of it, and a parameter hides what its name stands for outside. The source leads to all literals that a
    value came from. Values and sources are referred to, not copied, so self-references as ``a = a + a`` in a long text
    don't grow, and nothing is cut.
    """
    if "=" not in text and ":" not in text and "</" not in text and "(" not in text and "ENV " not in text:
        return
    scopes = _scopes(text)
    ends = [len(text) + 1, *(x[1] for x in scopes)]
    hidden = [frozenset(), *(x[2] for x in scopes)]
    known: dict[tuple[int, str], tuple[str | Long, Source]] = {}
    firsts: dict[tuple[int, str], _Pair] = {}
    found: list[_Pair] = []
    chain, n_scopes, at, named = [0], 0, 0, None
    holders, held, n_held = _holders(text), [], 0

    def named_or(pair: _Pair, word: str, raw: str, span: tuple[int, int] | None) -> bool:
        """Add what a word stands for, or the word as it is; whether it is known."""
        for scope in reversed(pair.scopes):
            if (scope, word) in known:
                pair.parts.append(known[scope, word][0])
                pair.source.names.append(known[scope, word][1])
                return True
            if word in hidden[scope]:
                break
        else:
            if _WORD.fullmatch(word):
                pair.waiting.append((len(pair.parts), word, span))
        pair.parts.append(raw)
        return False

    def literal(pair: _Pair, at: int) -> int:
        """Add a string literal that begins at ``at``, if there is one; the end of it."""
        prefix = _PREFIX.match(text, at)
        quoted = _STRING.match(text, prefix.end() if prefix else at)
        if not quoted:
            return at
        group = quoted.lastindex or 1
        raw, (start, end) = quoted[group] or "", quoted.span(group)
        if scheme := _SCHEME.match(raw):
            raw, start = raw[scheme.end() :], start + scheme.end()
        inserted = _INSERT_F if prefix and "f" in prefix[0].lower() else _INSERT if "$" in raw and group not in _PLAIN else None
        done = 0
        for x in inserted.finditer(raw) if inserted else ():
            pair.parts.append(raw[done : x.start()])
            named_or(pair, next(filter(None, x.groups())), x[0], None)
            done = x.end()
        pair.parts.append(raw[done:])
        pair.source.places.append((start, end))
        at = quoted.end()
        if (percent := _PERCENT.match(text, at)) and "%" in raw:
            for word in re.findall(r"\w+", percent[1]):
                named_or(pair, word, "", None)
            at = percent.end() + (text[percent.end() : percent.end() + 1] == ")")
        elif join := _JOIN.match(text, at):
            at = listed_items(pair, join.end())[1]
        return at

    def listed_items(pair: _Pair, at: int, apart: bool = False) -> tuple[list[_Pair], int]:
        """Literals within brackets that are open: those beside each other are one value; with ``apart``, a comma ends it."""
        out = [pair]
        blank = re.compile(r"\s*").match(text, at)
        at = blank.end()
        while (end := literal(out[-1], at)) > at:
            at = end
            between = _NEXT.match(text, at)
            if not between:
                break
            at = between.end()
            if apart and "," in between[0]:
                out.append(_Pair(pair.name, [], Source([], []), [], pair.scopes))
        closing = _CLOSE.match(text, at)
        return out, closing.end() if closing else at

    def value_of(pair: _Pair, at: int, config: bool) -> tuple[list[_Pair], int]:
        """Parse what is given to a name: a pair for each value that it may get, and where they end."""
        opened = _OPEN.match(text, at) if text[at : at + 1] in ("[", "(") else None
        if opened:
            return listed_items(pair, opened.end(), apart=True)
        called = _CALLED.match(text, at)
        if called:
            at = called.end()
        if scheme := _SCHEME.match(text, at):
            at, config = scheme.end(), True
        while True:
            end = literal(pair, at)
            if end > at:
                at = end
            elif bare := _BARE.match(text, at):
                word, at = bare[0], bare.end()
                if not named_or(pair, word.strip("${}"), word, bare.span()):
                    jwt = word.startswith("eyJ")
                    if text[at : at + 1] in ("(", "[") or not jwt and (_DOTTED.fullmatch(word) or not config and _NAME.fullmatch(word)):
                        pair.parts[-1] = ""  # a name, a call or a part of something: no literal
                    else:
                        pair.source.places.append(bare.span())
            else:
                break
            plus = _PLUS.match(text, at)
            if not plus or not (_STRING.match(text, plus.end()) or _PREFIX.match(text, plus.end()) or _WORD.match(text, plus.end())):
                break
            at = plus.end()
        out = [pair]
        while pair.source.places and (other := _ELSE.match(text, at)) and (":" not in other[0] or called and "?" in called[0]):
            out.append(_Pair(pair.name, [], Source([], []), [], pair.scopes))
            at = literal(out[-1], other.end())
        return out, at

    while m := _START.search(text, at):
        while n_scopes < len(scopes) and scopes[n_scopes][0] <= m.start():
            n_scopes += 1
            chain = [x for x in chain if ends[x] > scopes[n_scopes - 1][0]]
            chain.append(n_scopes)
        chain = [x for x in chain if ends[x] > m.start()]
        while n_held < len(holders) and holders[n_held][0] <= m.start():
            held = [x for x in held if x[1] > holders[n_held][0]] + [holders[n_held]]
            n_held += 1
        held = [x for x in held if x[1] > m.start()]
        inside = tuple(chain)
        names = re.findall(r"\w+", m["many"]) if m["many"] else [m["name"] or m["typed"] or m["index"] or m["env"] or m["argument"] or m["element"]]
        if names[0] in _PLAIN_KEYS and held:
            names = [held[-1][2]]
        name, at = names[-1], m.end()
        given: list[_Pair] = []
        first = _Pair(names[0], [], Source([], []), [], inside)
        if m["element"]:
            body = m["body"]
            begin = m.start("body") + len(body) - len(body.lstrip())
            first.parts.append(body.strip())
            first.source.places.append((begin, begin + len(body.strip())))
            at = m.end("element")  # its attributes may be pairs as well
            given = [first]
        elif m["name"] and (block := _BLOCK.match(text, at)):
            spans, at = _block(text, block.end(), text.rfind("\n", 0, m.start()) + 1)
            first.source.places.extend(spans)
            first.parts.append("\n".join(text[x:y] for x, y in spans))
            given = [first]
        elif m["many"]:
            for k, own in enumerate(names):
                one, at = value_of(_Pair(own, [], Source([], []), [], inside), at, False)
                given += one
                comma = re.compile(r"[ \t]*,[ \t]*").match(text, at)
                if not comma or k + 1 == len(names):
                    break
                at = comma.end()
            if len(given) == 1:  # one value for all of them, or an argument after others
                given = [given[0]._replace(name=name)]
        else:
            given, at = value_of(first, at, bool(m["env"]) or text[m.end() - 1 : m.end()] == "=" and _CONFIG.match(text, text.rfind("\n", 0, m.start()) + 1, m.end()) is not None)
        for k, pair in enumerate(given):
            value = _value(pair.parts) if any(pair.parts) else ""
            if not value and not pair.waiting:
                continue
            if not m["element"] and (k == 0 or m["many"]):
                if value:
                    known[inside[-1], pair.name] = (value, pair.source)
                firsts.setdefault((inside[-1], pair.name), pair)
            found.append(pair)
            if named and pair.name in _VALUE:
                found.append(pair._replace(name=named, waiting=[]))
        told = _TOLD.match(text, m.end()) if name in _NAMING else None
        named = told[1] if told else None
    # from below: what a name stands for there may wait for something further down itself
    place = {id(x.source): i for i, x in enumerate(found)}
    for i in range(len(found) - 1, -1, -1):
        pair = found[i]
        for k, word, span in pair.waiting:
            later = next((x for scope in reversed(pair.scopes) if (x := firsts.get((scope, word)))), None)
            if later is not None and place[id(later.source)] > i:
                pair.parts[k] = _value(later.parts)
                pair.source.names.append(later.source)
                if span in pair.source.places:
                    pair.source.places.remove(span)
    for pair in found:
        yield pair.name, _value(pair.parts), pair.source


def scan(text: str | None, least: float = 0.4) -> list[Span]:
    """All spans of a text, by start, then kind. Base patterns, and ``pair``: literals whose target's name is
    sensitive and whose value looks like a secret, by the product of both scores. Null counts as empty."""
    text = text or ""
    found = base_spans(text)
    best: dict[tuple[int, int], Span] = {}
    seen: dict[int, Source] = {}
    for name, value, source in pairs(text):
        s = name_score(name)
        if s and (s := s * literal_score(value, _PHRASE.search(name) is not None)) >= least:
            open_ = [source]
            while open_:
                x = open_.pop()
                if id(x) in seen:
                    continue
                seen[id(x)] = x
                open_ += x.names
                for start, end in x.places:
                    if end > start and (start, end) not in best:
                        best[start, end] = Span("pair", start, end, name, round(s, 6))
    if "://" in text and "@" in text:
        for m in _URL.finditer(text):
            if (s := round(0.9 * literal_score(m[1]), 6)) >= least and m.span(1) not in best:
                best[m.span(1)] = Span("pair", *m.span(1), "url password", s)
    return sorted([*found, *best.values()], key=lambda x: (x.start, KINDS.index(x.kind), x.end))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


FINDINGS = "findings array<struct<kind:string,start:int,end:int,name:string,score:double>>"
_FINDING = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.4) -> DataFrame:
    """Scan every whole text. Returns, per row of ``docs``: ``id_col``, ``n_assign``, ``n_access``, ``n_hex``, ``n_pair``,
    ``base_sha256``, ``spans`` (see ``listed``) and ``findings`` (kind, start, end, name of the target, score).

    Offsets count code points, end exclusive. A null or empty text has no spans. Ids may repeat or be null; other
    columns aren't read. One row is held at a time, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [scan(t, least) for t in part.column(1).to_pylist()]
                base = [[x for x in spans if x.kind != "pair"] for spans in found]
                out = {id_col: part.column(0)}
                out |= {f"n_{kind}": pa.array([sum(x.kind == kind for x in spans) for spans in found], pa.int64()) for kind in KINDS}
                out["base_sha256"] = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string())
                out["spans"] = pa.array([listed(x) for x in found], pa.string())
                out["findings"] = pa.array([[x._asdict() for x in spans] for spans in found], _FINDING)
                yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_pair bigint, base_sha256 string, spans string, {FINDINGS}")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.4, mask: str = "[SECRET]") -> DataFrame:
    """``id_col`` and the text with every span masked; overlapping spans are masked as one. Null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = []
                for t in part.column(1).to_pylist():
                    done, at = [], 0
                    for x in scan(t, least):
                        if x.start >= at:
                            done += [t[at : x.start], mask]
                        at = max(at, x.end)
                    texts.append(None if t is None else "".join(done) + t[at:])
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), text_col: pa.array(texts, pa.string())})

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{text_col}` string")
