"""Personal data, also in disguise: transducers rewrite a text and keep where each piece came from.

A transducer turns the source into segments (source start, source end, output). Homoglyphs become the
letters they imitate, invisible characters vanish, spelled digits become digits, and "(at)", "[dot]" or
"name at host dot org" become the signs. Identifiers are detected in the source as it stands (the
identity transducer) and in the rewritten text, and spans of the latter are mapped back through the
segments to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from pagelog.llm.automaton import Scanner
from pagelog.llm.common import map_batches, own_columns, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

#: Letters that look like Latin ones.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅ" + "αοκνρτυιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijshdqwABEKMHOPCTYXIJS" + "aokvptuiABEZHIKMNOPTYX",
        strict=True,
    )
)
#: Characters that don't show.
INVISIBLE = "­​‌‍⁠﻿"
#: Digits as words, per language.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
#: How the signs are said.
AT_WORDS = ("at", "arobase", "arroba", "ät")
DOT_WORDS = ("dot", "punkt", "point", "punto")
PLUS_WORDS = ("plus",)

_DIGIT_OF = {w: str(k) for words in DIGIT_WORDS.values() for k, w in enumerate(words.split())}
_DIGIT_OF["oh"] = "0"


def _any(words: Iterable[str]) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


def _compatible() -> dict[str, str]:
    """Fullwidth forms and mathematical letters and digits with one ASCII character as their compatible form."""
    found = {}
    for block in (range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), (0xFE52, 0xFE6B, 0xFF61, 0x3002, 0x2024)):
        for c in map(chr, block):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                found[c] = plain
    for zero in (0x0660, 0x06F0, 0x0966):  # other decimal digits
        found |= {chr(zero + k): str(k) for k in range(10)}
    return found | {"。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " "}


LOOKALIKES = HOMOGLYPHS | _compatible()
LOOKALIKES |= dict.fromkeys(INVISIBLE, "")
#: The blocks in which they lie: a class of few ranges is searched much faster.
_ODD = re.compile("[\u00a0\u00ad\u0370-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u200b-\u2024\u2060\u3002\ufe52-\uff61\ufeff\U0001d400-\U0001d7ff]")
assert all(map(_ODD.match, LOOKALIKES)), "a look-alike outside these blocks"
_DIGITS = _any(_DIGIT_OF)
_OPEN, _CLOSE = r"[ ]{0,2}[(\[{<][ ]{0,2}", r"[ ]{0,2}[)\]}>][ ]{0,2}"
_HOST = r"[a-z0-9-]+"
_DOT = rf"(?:\.|{_OPEN}(?:{_any(DOT_WORDS)}|\.){_CLOSE}| (?:{_any(DOT_WORDS)}) )"
_SIGNS = re.compile(
    rf"(?P<at>{_OPEN}(?:{_any(AT_WORDS)}|@){_CLOSE}|(?<=[a-z0-9]) (?:{_any(AT_WORDS)}) (?={_HOST}{_DOT}[a-z]))"
    rf"|(?P<dot>{_OPEN}(?:{_any(DOT_WORDS)}|\.){_CLOSE}|(?<=[a-z0-9]) (?:{_any(DOT_WORDS)}) (?=[a-z0-9]))"
    rf"|(?P<plus>\b(?:{_any(PLUS_WORDS)})[ -](?=(?:[0-9]|(?:{_DIGITS})\b)))"
    rf"|(?P<digits>\b(?:{_DIGITS})(?:[ -](?:{_DIGITS}))*\b)",
    re.IGNORECASE,
)
_ONE_DIGIT = re.compile(_DIGITS, re.IGNORECASE)


def _spoken_patterns() -> list[str]:
    """Over lower-cased bytes. A text in which none of these matches has no sign or digit that _SIGNS could
    rewrite so that an identifier is completed."""
    digit, dots, ats = f"(?:{_DIGITS})", f"(?:{_any(DOT_WORDS)})", f"(?:{_any(AT_WORDS)})"
    return [
        rf"{digit}(?:[ -]{digit}[ -]{digit}|[ .-][0-9]|(?:\.| {dots} ){digit})",
        rf"[0-9][ .-]{digit}|(?:{_any(PLUS_WORDS)})[ -](?:{digit}|[0-9])",
        rf"[(\[{{<] ? ?(?:{ats}|{dots}|@|\.) ? ?[)\]}}>]",
        rf" {ats} [a-z0-9-]+(?:\.[a-z]| {dots} | ? ?[(\[{{<])|[@0-9][a-z0-9-]* {dots} [a-z0-9]",
    ]


_EMAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Identifiers of a text as it stands: per kind leftmost and not overlapping; by start, then kind.

    Equal to searching with the plain expressions, but in time linear in the text's length: an address
    is found from its @, and digits are only tried where a run of them begins.
    """
    found: list[tuple[int, int, int]] = []
    limit = 0
    for m in _EMAIL.finditer(text):
        start = m.start()
        while start > limit and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            limit = m.end()
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-9:]) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    found.sort()
    return [(KINDS[k], a, b) for a, k, b in found]


class Rewritten:
    """A rewritten text and its segments; spans of it map back to the source."""

    def __init__(self, source: str):
        self.text = source
        self._from = [0]  # where segments begin in the rewritten text
        self._source = [(0, len(source), True)]  # (begin, end, copied one to one)

    def apply(self, expression: re.Pattern, output) -> Rewritten:
        """The transducer that copies what the expression doesn't match and writes output(match) for what it does."""
        parts, starts, sources = [], [], []
        at = size = 0

        def copy(to: int) -> None:
            nonlocal at, size
            while at < to:
                k = bisect_right(self._from, at) - 1
                begin, end, copied = self._source[k]
                stop = min(to, self._from[k + 1] if k + 1 < len(self._from) else len(self.text))
                starts.append(size)
                shift = at - self._from[k]
                sources.append((begin + shift, begin + shift + stop - at, True) if copied else (begin, end, False))
                parts.append(self.text[at:stop])
                size += stop - at
                at = stop

        for m in expression.finditer(self.text):
            if m.end() == m.start() or (put := output(m)) is None:
                continue
            copy(m.start())
            a, b = self.back(m.start(), m.end())
            if put:
                starts.append(size)
                sources.append((a, b, False))
                parts.append(put)
                size += len(put)
            at = m.end()
        copy(len(self.text))
        done = Rewritten("".join(parts))
        done._from, done._source = starts or [0], sources or [(0, 0, False)]
        return done

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the rewritten text that isn't empty."""
        k = bisect_right(self._from, start) - 1
        begin, _, copied = self._source[k]
        first = begin + (start - self._from[k] if copied else 0)
        k = bisect_right(self._from, end - 1) - 1
        begin, stop, copied = self._source[k]
        return first, begin + (end - self._from[k]) if copied else stop


def _spoken(m: re.Match) -> str | None:
    if m["at"]:
        return "@"
    if m["dot"]:
        return "."
    if m["plus"]:
        return "+"
    return "".join(_DIGIT_OF[w[0].lower()] for w in _ONE_DIGIT.finditer(m[0]))


class PiiScanner:
    """find() gives, for each text, its base spans (of the text as it stands) and the added ones, which
    only show once it is rewritten. Both in source code points, by start, the end exclusive. An added
    span overlaps no base span of its kind.

    One automaton tells which texts hold a spoken sign or digit; those are rewritten whole.
    """

    def __init__(self):
        self.spoken = Scanner(_spoken_patterns())

    def normalise(self, texts: list[str]) -> list[Rewritten | None]:
        done: list[Rewritten | None] = [None] * len(texts)
        plain = list(texts)
        for k, text in enumerate(texts):
            if not text.isascii() and _ODD.search(text):
                done[k] = Rewritten(text).apply(_ODD, lambda m: LOOKALIKES.get(m[0]))
                plain[k] = done[k].text
        for k in self.spoken.places([t.lower().encode("utf-8", "surrogatepass") for t in plain]):
            done[k] = (done[k] or Rewritten(texts[k])).apply(_SIGNS, _spoken)
        return done

    def find(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        out = []
        for text, done in zip(texts, self.normalise(texts), strict=True):
            base, added = detect(text), []
            for kind, a, b in detect(done.text) if done is not None else ():
                a, b = done.back(a, b)
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if not any(k == kind and a < y and x < b for k, x, y in base):
                    added.append((kind, a, b))
            out.append((base, added))
        return out


SCHEMA = "doc_id long, kind array<string>, start array<int>, end array<int>, base array<boolean>"


def scan_pii(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): its spans as arrays by start, then kind; base tells
    those of the text as it stands from those found through the transducers.

    A null text counts as empty; a null doc_id stays null; equal rows give equal rows; further columns
    are ignored. The rows aren't moved: no shuffle, memory for one Arrow batch.
    """

    held: list[PiiScanner] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(PiiScanner())
        rows = []
        for base, added in held[0].find(texts_of(batch)):
            rows.append(sorted([(a, KINDS.index(k), b, True) for k, a, b in base] + [(a, KINDS.index(k), b, False) for k, a, b in added]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([[KINDS[s[1]] for s in r] for r in rows], pa.list_(pa.string())),
                pa.array([[s[0] for s in r] for r in rows], pa.list_(pa.int32())),
                pa.array([[s[2] for s in r] for r in rows], pa.list_(pa.int32())),
                pa.array([[s[3] for s in r] for r in rows], pa.list_(pa.bool_())),
            ],
            names=["doc_id", "kind", "start", "end", "base"],
        )

    return map_batches(own_columns(docs, "doc_id", "text"), run, SCHEMA, held)


def redact(text: str, spans: list[Span], mark: str = "[{kind}]") -> str:
    """The text with every span replaced; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark.format(kind=kind.upper())]
            at = b
    return "".join(out) + text[at:]
