"""Personal data with offset-preserving deobfuscation (operator 1).

Base spans are found in the text as it stands (patterns below, failing matches dropped).  Then two
transducers rewrite the text, each carrying for every written character the source range it came
from:

1. look-alikes: full-width and mathematical characters, Cyrillic and Greek letters that look Latin,
   foreign digits, odd dashes, spaces and dots become their ASCII form; invisible characters and
   combining marks go; character references of ASCII (``&#64;``) and ``%40`` become the character;
2. disguises: ``[at]``, ``(at)``, `` at ``, ``_at_`` and the like become ``@``, ``[dot]``, `` dot ``,
   ``_dot_`` become ``.`` within an address or between digits, however long the address and however
   many dots it has, and spelled digits in runs of at least ``MIN_DIGITS`` digits, or of four numbers with dots
   between, become digits.

The detectors run again on the rewritten text, with and without the spelled digits; a found span is mapped to source characters and
added if rewriting changed something inside it, no base span of its kind holds all of it, and no
other added span overlaps it; base spans stay, also those that are fragments of an added one.  A
base span is not carried on over a dash that sets off words.  Disguises
made of plain words are taken only where they look like one: a bare `` at `` or ``_at_`` needs a spelled
dot after the next label (``met at example.com`` is no address); of spelled numbers the detectors decide (lengths, Luhn, octets).

Offsets are code points, ends exclusive.  Cases: null and empty texts have no span (the digest of
the empty string); rows that repeat a doc_id are reported one by one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import on_workers

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CARD_START = re.compile(r"[0-9](?:[\x20-]?[0-9]){13}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MIN_DIGITS = 10  # of the shortest phone number

# Letters of other scripts that look like the Latin ones below them.
LOOK_FROM = "АВЕКМНОРСТХаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονι"
LOOK_TO = "ABEKMHOPCTXaeopcyxijsdqwhABEZHIKMNOPTYXaovi"
# Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
# Dashes, spaces and dots that stand for the ASCII ones.
MARKS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", "․": ".", "。": ".", "·": ".", "﹫": "@"}
# Dashes that also stand between words.
SET_OFF = "–—"
# Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _look_alikes() -> dict[str, str]:
    out = dict(zip(LOOK_FROM, LOOK_TO, strict=True)) | MARKS | dict.fromkeys(INVISIBLE, "")
    # by rule: whatever Unicode decomposes to one ASCII letter, digit or mark, and foreign digits
    for low, high in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2070, 0x209D), (0x2460, 0x24EB)):
        for c in map(chr, range(low, high)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                out.setdefault(c, plain)
    out |= dict.fromkeys(map(chr, range(0x0300, 0x0370)), "")  # combining marks
    for low in (0x0660, 0x06F0, 0x0966, 0x09E6):
        out |= {chr(low + d): str(d) for d in range(10)}
    return out


LOOK_ALIKES = _look_alikes()
# characters beyond the basic plane by their ranges: such classes are matched quickly
_LOOK = re.compile("[" + re.escape("".join(c for c in LOOK_ALIKES if ord(c) < 0x10000)) + "\U0001D400-\U0001D7FF]")

# references to one ASCII character
_REFERENCE = re.compile(r"&#0*([0-9]{2,3});|&#x0*([0-9a-f]{2});|&(commat|period);|%40(?=[A-Za-z0-9-]+\.)", re.I)
# The references with names.
_NAMED = {"commat": "@", "period": "."}

_BRACKETED = r"[\[({<]\s?{}\s?[\])}>]"
_AT = r"(?:\s?(?:" + _BRACKETED.replace("{}", "(?:at|@|arroba|a)", 1) + r")\s?)"
_DOT = r"(?:\s?(?:" + _BRACKETED.replace("{}", r"(?:dot|\.|punto|point|punkt)", 1) + r")\s?)"
_STOP = "the|a|an|this|that|my|your|our|his|her|their|its|every|each|some|any|no"
_DISGUISED_AT = re.compile(
    # a bracketed at; or a bare one with at least one spelled dot behind it; or a spaced @; or one tied by lines or dashes
    rf"(?:{_AT}(?=[A-Za-z0-9-]))|(?:\s(?:at|AT)\s(?!(?:{_STOP})\b)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*+(?:{_DOT}|\s(?:dot|DOT)\s)[A-Za-z0-9-]))|(?:(?<=[A-Za-z0-9])\s@\s(?=[A-Za-z0-9-]+\s?(?:\.|{_DOT})))"
    r"|(?:(?<=[A-Za-z0-9])_at_(?=[A-Za-z0-9-]+_dot_[A-Za-z0-9]))|(?:(?<=[A-Za-z0-9])-at-(?=[A-Za-z0-9]+-dot-[A-Za-z0-9]))",
    re.I,
)
_DISGUISED_DOT = re.compile(rf"{_DOT}|\s(?:dot|DOT)\s|_dot_|-dot-", re.I)
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9_%+.-]+")
_NUMBER_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
# a digit, spelled or not, and runs of them
_DIGIT = rf"(?:{_NUMBER_WORD}|[0-9])"
_RUN = re.compile(rf"(?<![A-Za-z]){_DIGIT}(?:[\s,.()-]{{0,2}}{_DIGIT}){{3,}}(?![A-Za-z])", re.I)
_ONE = re.compile(_DIGIT, re.I)
_ENDS_IN_DIGIT = re.compile(rf"(?<![A-Za-z]){_DIGIT}\Z", re.I)
_BEGINS_WITH_DIGIT = re.compile(rf"{_DIGIT}(?![A-Za-z])", re.I)
_PLUS = re.compile(r"\bplus\s(?=(?:[0-9]|" + _NUMBER_WORD + r"))", re.I)
# signs of a disguise, looked for before anything slower runs: the brackets and words of _AT and _DOT, a bare dot, a spaced @
_SIGN = re.compile(_BRACKETED.replace("{}", r"(?:at|@|arroba|a|dot|\.|punto|point|punkt)", 1) + r"|\sdot\s|\s@\s|plus\s|[_-]dot[_-]", re.I)


def _plain_character(m: re.Match) -> str:
    """What a reference stands for; anything but printable ASCII stays as it is."""
    if m[3]:
        return _NAMED[m[3].lower()]
    code = int(m[1]) if m[1] else int(m[2] or "40", 16)
    return chr(code) if 0x20 < code < 0x7F else m[0]


def _disguised(text: str) -> bool:
    low = text.lower()
    return any(word in low for word in DIGITS) or bool(_SIGN.search(text))


def _dots(text: str) -> list[tuple[int, int, str]]:
    """Edits that make dots of spelled ones: within an address's domain or local part, or between digits.

    Two walks over the dots carry the state of the address: forward whether an at sign has opened a
    domain that has gone on in labels ever since, backward whether one follows a local part's rest.
    """
    found = list(_DISGUISED_DOT.finditer(text))
    taken = [False] * len(found)
    opened, at = False, 0
    for k, m in enumerate(found):
        _, sign, label = text[at : m.start()].rpartition("@")
        opened = bool((sign or opened) and _LABELS.fullmatch(label))
        taken[k] = opened
        at = m.end()
    follows, end = False, len(text)
    for k in range(len(found) - 1, -1, -1):
        low = found[k].end()
        run = _LOCAL_RUN.match(text, low, end)
        stop = run.end() if run else low
        follows = stop > low and (text[stop : stop + 1] == "@" if stop < end else follows)
        taken[k] |= follows
        end = found[k].start()
    for k, m in enumerate(found):
        # the longest digit word has five letters: eight characters show it and its neighbour
        taken[k] = taken[k] or bool(
            _ENDS_IN_DIGIT.search(text[max(0, m.start() - 8) : m.start()]) and _BEGINS_WITH_DIGIT.match(text[m.end() : m.end() + 8])
        )
    return [(*m.span(), ".") for m, t in zip(found, taken, strict=True) if t]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits that make figures of the spelled digits in runs long enough to matter."""
    edits = []
    for run in _RUN.finditer(text):
        ones = list(_ONE.finditer(text, *run.span()))
        gaps = [text[x.end() : y.start()] for x, y in zip(ones, ones[1:], strict=False)]
        octets = sum("." in g for g in gaps) == 3
        if all(m[0].isdigit() for m in ones) or not (octets or len(ones) >= MIN_DIGITS):
            continue
        at = ones[0].start()
        for k, m in enumerate(ones):
            new = DIGITS.get(m[0].lower(), m[0])
            # what stands next to a spelled digit separates nothing, but for an address's dots
            joins = k and (not m[0].isdigit() or not ones[k - 1][0].isdigit())
            if joins and octets and "." in gaps[k - 1]:
                new = "." + new
            low = at if joins else m.start()
            if new != text[low : m.end()]:
                edits.append((low, m.end(), new))
            at = m.end()
    return edits


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping addresses; read from the @ outwards, so plain text costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches that hold, by start, then kind as listed."""
    found = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), 1))
    if _CARD_START.search(text):
        for m in CARD.finditer(text):
            digits = _digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits_of(m[0])) <= 15:
                found.append((*m.span(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


class Rewritten:
    """A text with, for every character, its source range and whether it was changed."""

    def __init__(self, text: str):
        self.text = text
        # (rewritten position, source position, changed) at which a stretch begins
        self.pieces = [(0, 0, len(text), False)]  # (position, source start, source end, changed)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace rewritten ranges (sorted, disjoint), keeping the way back to the source."""
        if not edits:
            return
        out, pieces, at, length = [], [], 0, 0
        source = self._locator()

        def copy(low: int, high: int) -> None:
            nonlocal length
            for a, b, s, e, changed in source(low, high):
                pieces.append((length, s, e, changed))
                out.append(self.text[a:b])
                length += b - a

        for low, high, new in edits:
            copy(at, low)
            parts = list(source(low, high))
            if parts:
                pieces.append((length, parts[0][2], parts[-1][3], True))
            out.append(new)
            length += len(new)
            if not new:
                pieces[-1:] = [(length, *p[1:]) for p in pieces[-1:]]
            at = high
        copy(at, len(self.text))
        self.text, self.pieces = "".join(out), pieces

    def _locator(self):
        import bisect

        starts = [p[0] for p in self.pieces]

        def inside(low: int, high: int):
            k = max(0, bisect.bisect_right(starts, low) - 1)
            while k < len(self.pieces) and low < high:
                p, s, e, changed = self.pieces[k]
                end = starts[k + 1] if k + 1 < len(starts) else len(self.text)
                stop = min(high, end)
                if stop > low:
                    yield (low, stop, s, e, True) if changed else (low, stop, s + low - p, s + stop - p, False)
                    low = stop
                k += 1

        return inside

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """(source start, source end, changed inside) of a rewritten range."""
        parts = list(self._locator()(start, end))
        return parts[0][2], parts[-1][3], any(p[4] for p in parts) or len(parts) > 1


def normalised(text: str) -> list[Rewritten]:
    """The text after both transducers, without and with spelled digits; empty if neither finds anything."""
    r = Rewritten(text)
    odd = not text.isascii() and _LOOK.search(text)
    if odd:
        r.replace([(m.start(), m.end(), LOOK_ALIKES[m[0]]) for m in _LOOK.finditer(text) if m[0] in LOOK_ALIKES])
    if "&" in text or "%40" in text:
        written = [(*m.span(), _plain_character(m)) for m in _REFERENCE.finditer(r.text)]
        r.replace([e for e in written if len(e[2]) == 1])
    stages = []
    if _disguised(r.text):
        edits = []
        for m in _DISGUISED_AT.finditer(r.text):
            edits.append((*m.span(), "@"))
        r.replace(edits)
        r.replace(_dots(r.text))
        edits = _spelled(r.text)
        if edits and r.text != text:
            plain = Rewritten(r.text)
            plain.pieces = r.pieces
            stages.append(plain)
        r.replace(edits)
        r.replace([(*m.span(), "+") for m in _PLUS.finditer(r.text)])
    return stages if r.text == text else [*stages, r]


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans)."""
    base = spans(text)
    found = {}
    for r in normalised(text):
        for a, b, kind in spans(r.text):
            s, e, changed = r.back(a, b)
            own = [(x, y) for x, y, k in base if k == kind and s < y and x < e]
            held = any(x <= s and e <= y for x, y in own)
            set_off = any((s < x and text[x - 1] in SET_OFF) or (y < e and text[y] in SET_OFF) for x, y in own)
            if changed and not held and not set_off:
                found[s, e, kind] = None
    added: list[tuple[int, int, str]] = []
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if not any(s < y and x < e for x, y, _ in added):
            added.append((s, e, kind))
    return base, added


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base counts per kind, base digest, all spans and the number added, per row of ``docs``."""
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"

    def run(batches):
        for batch in batches:
            rows = [all_spans(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(0).cast(pa.int64()),
                    *[pa.array([sum(k == kind for _, _, k in b) for b, _ in rows], pa.int64()) for kind in KINDS],
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows]),
                    pa.array([joined(sorted(b + a, key=lambda x: (x[0], KINDS.index(x[2])))) for b, a in rows]),
                    pa.array([len(a) for _, a in rows], pa.int64()),
                ],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    return on_workers(docs).select("doc_id", F.col("text")).mapInArrow(run, schema)
