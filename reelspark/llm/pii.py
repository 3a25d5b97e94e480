"""Personal data by offset-preserving deobfuscation.

Base spans come from the raw text: e-mail and IP addresses, card numbers that pass Luhn, telephone numbers. Then
transducers rewrite disguises (look-alike and full-width characters, zero-width characters, spelled digits, "at" and "dot")
while keeping for every character of the rewritten text the span of the source that made it; the same detectors run on the
rewritten text, and what they find is mapped back to source offsets. A span is added if a transducer changed something inside it
and no base span of its kind overlaps it, so base spans always stay.

Spelled digits are rewritten in runs of three digits or numbers and more, an address in words only if it ends in letters, so that prose stays
as it is. Offsets count code points, ends are exclusive. Each detector takes time in proportion to the text: a run of digits or of
address characters is never scanned anew from each of its positions.

Edge cases: null text is empty and has no spans; a null doc_id is kept; repeated rows are answered each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, map_texts

KINDS = ("email", "ip", "card", "phone")
#: Patterns, fixed by the contract.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: the run of address characters before it, as far as the last match's end, and a dotted domain."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            floor = m.end()
            yield start, floor
        else:
            floor = at + 1
        at = text.find("@", floor)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each span, sorted; spans of a kind don't overlap."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


#: Look-alikes of Latin letters, fixed values; full-width forms follow from their offset.
_ALIKE = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABEKMHOPCTXaeopcyxijsdh" + "ABEZHIKMNOPTYXoav", strict=True))
_ALIKE |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_ALIKE |= {"․": ".", "。": ".", "﹒": ".", "﹫": "@", " ": " ", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-"}
_ALIKE |= dict.fromkeys("​‌‍⁠﻿­", "")
#: Names of the digits in four languages, fixed values.
_SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
}
_NUMBER = "|".join(sorted(_SPELLED, key=lambda w: (-len(w), w)))
_AT = r"at|arroba|arobase|klammeraffe"
_DOT = r"dot|punto|punkt|point"
#: What the second transducer rewrites: at and dot in brackets, the parts of an address, plus before a number, and runs of three spelled digits or numbers.
_ITEM, _GAP = rf"(?:\b(?:{_NUMBER})\b|[0-9]+)", "[ ,.-]+"
_BRACKETED_AT = rf"[ ]?[\[({{<][ ]?(?:{_AT}|@)[ ]?[\])}}>][ ]?"
_BRACKETED_DOT = rf"[ ]?[\[({{<][ ]?(?:{_DOT}|\.)[ ]?[\])}}>][ ]?"
_SHAPES = {
    "brackets": rf"(?P<at>{_BRACKETED_AT})|(?P<dot>{_BRACKETED_DOT})",
    "address": rf"(?P<address>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: (?:{_AT}) |{_BRACKETED_AT}|@)[A-Za-z0-9-]+(?:(?: (?:{_DOT}) |{_BRACKETED_DOT}|\.)[A-Za-z0-9-]+)*(?: (?:{_DOT}) |{_BRACKETED_DOT}|\.)[A-Za-z]{{2,}}(?![A-Za-z0-9-]))",
    "plus": rf"(?P<plus>\bplus(?= (?:{_NUMBER}|[0-9])))",
    "run": rf"(?P<run>(?<![A-Za-z0-9]){_ITEM}(?:{_GAP}{_ITEM}){{2,}}+)",
}
_HEAD, _TAIL = re.compile(r"[^\W_]+"), re.compile(r"[^\W_]+\Z")


def _may_run(low: str) -> bool:
    """Whether three items of a run may follow each other: the middle one stands alone between gaps, its neighbours may touch other signs."""
    words = low.replace(",", " ").replace(".", " ").replace("-", " ").split()
    for i, w in enumerate(words):
        if (w in _SPELLED or w.isdigit()) and 0 < i < len(words) - 1:
            before, after = _TAIL.search(words[i - 1]), _HEAD.match(words[i + 1])
            if before and after and (before[0] in _SPELLED or before[0][-1].isdigit()) and (after[0] in _SPELLED or after[0][0].isdigit()) and {w, before[0], after[0]} & _SPELLED.keys():
                return True
            # A longer run of numbers may have its spelled digit further on: it shows as the middle or neighbour of another three there.
    return False


@cache
def _pattern(shapes: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(_SHAPES[x] for x in shapes), re.IGNORECASE)


def _shapes(text: str) -> tuple[str, ...]:
    """The shapes that may stand in a text: what none of their occurrences can do without is looked for, so leaving out the others changes nothing."""
    low = text.casefold()
    brackets = any(c in low for c in "([{<")
    there = {
        "brackets": brackets,
        "address": brackets or "@" in low or any(w in low for w in _AT_WORDS),
        "plus": "plus " in low,
        "run": _may_run(low),
    }
    return tuple(x for x, here in there.items() if here)


_AT_WORDS = [f" {w} " for w in _AT.split("|")]
_INNER = re.compile(rf"(?P<at> (?:{_AT}) |{_BRACKETED_AT})|(?P<dot> (?:{_DOT}) |{_BRACKETED_DOT})", re.IGNORECASE)
_SPELLED_WORD = re.compile(rf"\b(?:{_NUMBER})\b", re.IGNORECASE)
_LOOKS = re.compile("[" + re.escape("".join(sorted(_ALIKE))) + "]")


class Rewritten:
    """A text after edits (source begin, source end, what stands there: one character or none), and the way back.

    Only the edits are kept, with the place of each in the new text: any offset follows from the last edit before it.
    """

    def __init__(self, source: str, edits: list[tuple[int, int, str]]) -> None:
        parts, self.places, self.edits, at, length = [], [], edits, 0, 0
        for begin, end, put in edits:
            parts += [source[at:begin], put]
            length += begin - at
            self.places.append(length)
            length += len(put)
            at = end
        parts.append(source[at:])
        self.text = "".join(parts) if edits else source

    def _char(self, c: int) -> tuple[int, int]:
        """The source span of one character of the new text."""
        k = bisect_right(self.places, c) - 1
        if k < 0:
            return c, c + 1
        begin, end, put = self.edits[k]
        if put and self.places[k] == c:
            return begin, end
        own = end + c - self.places[k] - len(put)
        return own, own + 1

    def back(self, s: int, e: int) -> tuple[int, int, bool]:
        """The source span of a span, and whether an edit stands in it: at its ends only one that put a character there."""
        low, high = bisect_left(self.places, s), bisect_left(self.places, e)
        changed = any(self.edits[k][2] or self.places[k] > s for k in range(low, high))
        return self._char(s)[0], self._char(e - 1)[1], changed


def _alike(text: str) -> Rewritten:
    """The first transducer: characters that look like ASCII ones, or like nothing."""
    return Rewritten(text, [] if text.isascii() else [(m.start(), m.end(), _ALIKE[m[0]]) for m in _LOOKS.finditer(text)])


def _words(text: str) -> Rewritten:
    """The second: spelled digits, and at and dot in brackets or between the parts of an address."""
    edits: list[tuple[int, int, str]] = []
    shapes = _shapes(text)
    for m in _pattern(shapes).finditer(text) if shapes else ():
        s, e = m.span()
        kind = m.lastgroup
        if kind == "run":
            last = -1
            for w in _SPELLED_WORD.finditer(text, s, e):
                # Blanks, commas and hyphens between two spelled digits that follow each other are dropped.
                if last >= 0 and not text[last : w.start()].strip(" ,-"):
                    edits.append((last, w.start(), ""))
                edits.append((w.start(), w.end(), str(_SPELLED[w[0].lower()])))
                last = w.end()
        elif kind == "address":
            edits += [(w.start(), w.end(), "@" if w["at"] else ".") for w in _INNER.finditer(text, s, e)]
        elif kind == "plus":
            edits += [(s, e, "+"), (e, e + 1, "")]
        else:
            edits.append((s, e, "@" if kind == "at" else "."))
    return Rewritten(text, edits)


def deobfuscated(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that show only after rewriting, in source offsets. No gate stands before: what one passage gives doesn't hang on another."""
    first = _alike(text)
    second = _words(first.text)
    if not first.edits and not second.edits:
        return []
    added = []
    for s, kind, e in detect(second.text):
        begin, end, late = second.back(s, e)
        begin, end, early = first.back(begin, end)
        if (late or early) and not any(k == kind and a < end and begin < b for a, k, b in base):
            added.append((begin, kind, end))
    return added


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each (start, kind, end) and sorted by start, then kind."""
    base = detect(text) if text else []
    added = deobfuscated(text, base) if text else []
    return base, sorted(base + added) if added else base


def find_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added. One pass, no shuffle."""

    def search(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in bounded(batch):
                found = [find(t) for t in part["text"]]
                out = {"doc_id": part["doc_id"]}
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"] = [sum(x[1] == k for x in b) for b, _ in found]
                yield out | {
                    "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found],
                    "spans": [joined(a) for _, a in found],
                    "n_added": [len(a) - len(b) for b, a in found],
                }

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    columns = {"doc_id": F.col(id_column).cast("long"), "text": F.col(text_column)}
    return map_texts(documents, columns, search, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; where spans overlap, the first and longest covers the rest."""
    if not text:
        return text
    _, spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for s, kind, e in sorted(spans, key=lambda x: (x[0], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)
