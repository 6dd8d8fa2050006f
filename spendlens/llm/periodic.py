"""Periodic runs of words, as maximal pairs of an LCP-interval tree (operator 11).

A run is a stretch with smallest period q and length >= max(``MIN_LENGTH``, ``MIN_EXPONENT`` * q) that
no neighbouring word extends.  Words i and j = i + d that begin equal stretches of l words, with other
words before them and after them, are a maximal pair (i, j, l); with l >= max(MIN_LENGTH - d,
(MIN_EXPONENT - 1) * d) the stretch [i, j + l) has period d, and neither neighbour continues it.  So the
maximal pairs that satisfy the length constraint are the runs, and nothing is extended afterwards; a run of
period q also shows up with periods 2q, 3q, ... at the same place, of which the smallest is kept.

Per text: suffix array by prefix doubling over word numbers, LCP values, then the LCP intervals bottom-up.
An interval holds the places of its stretch by the word before them (the class lists); when two children
meet at l words, every place of the smaller one looks in the larger one for places of another class within
reach (``reach(l)``).  Occurrences of l words that are at most l / 3 apart lie in one progression of the
stretch's smallest period, so

* to the right of a place all of them have the same word before them: the nearest one names the class list
  that holds every partner,
* to the left only the farthest one can have another word before it.

That is two searches per place, whatever the number of classes; smaller children go into larger ones, and
the pairs found are at most a multiple of the words.  Memory is in proportion to one text.

Texts in which no stretch of ``MIN_LENGTH`` - 1 words comes twice have no run; they skip the tree.

Cases: null and empty texts and texts without words have no run and an empty collapsed text; a null doc_id
is allowed (``rewritten`` leaves its words as they are); rows are independent, so repeated rows repeat their
result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendlens.llm.common import on_workers, utf8

MIN_LENGTH = 6
MIN_EXPONENT = 4
_P = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document; one in ten ends in a planted repetition, given by its id alone."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers from 0."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def may_repeat(ids: np.ndarray, size: int) -> bool:
    """Whether some stretch of ``size`` words may come twice (hashes: never missed)."""
    last = len(ids) - size + 1
    if last < 2:
        return False
    total = np.zeros(last, np.uint64)
    for k in range(size):
        total = total * _P + (ids[k : k + last].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(29)
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by prefix doubling."""
    n = len(ids)
    rank, step = ids, 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = (rank + 1) * (n + 1)
        if step < n:
            key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


def lcp_values(ids: list[int], order: list[int]) -> list[int]:
    """Words shared by each suffix and the one before it in order; the first shares none."""
    n = len(ids)
    rank, out = [0] * n, [0] * n
    for r, place in enumerate(order):
        rank[place] = r
    same = 0
    for place in range(n):
        r = rank[place]
        if not r:
            same = 0
            continue
        other = order[r - 1]
        while place + same < n and other + same < n and ids[place + same] == ids[other + same]:
            same += 1
        out[r] = same
        if same:
            same -= 1
    return out


def reach(shared: int) -> int:
    """The largest distance at which a maximal pair of ``shared`` words is a run, 0 if there is none.

    A distance d needs shared >= max(MIN_LENGTH - d, (MIN_EXPONENT - 1) * d).
    """
    far = shared // (MIN_EXPONENT - 1)
    return far if far and shared >= MIN_LENGTH - far else 0


class Interval:
    """Places of one stretch: all in order, and in order by the word before them."""

    __slots__ = ("places", "by_class")

    def __init__(self, place: int, before: int) -> None:
        self.places = [place]
        self.by_class = {before: [place]}


def met(x: Interval, y: Interval, shared: int, before: list[int], out: list[tuple[int, int, int]]) -> Interval:
    """The union of two children that share ``shared`` words; appends the maximal pairs within reach."""
    small, large = (x, y) if len(x.places) < len(y.places) else (y, x)
    far = reach(shared)
    every = large.places
    if far:
        for own, places in small.by_class.items():
            for place in places:
                at = bisect_left(every, place)
                if at < len(every) and every[at] <= place + far:
                    named = before[every[at]]
                    if named != own:
                        partners = large.by_class[named]
                        for k in range(bisect_left(partners, place), bisect_right(partners, place + far)):
                            out.append((place, partners[k], shared))
                at = bisect_left(every, place - far)
                if at < len(every) and every[at] < place and before[every[at]] != own:
                    out.append((every[at], place, shared))
    for place in small.places:
        insort(every, place)
    for own, places in small.by_class.items():
        held = large.by_class.get(own)
        if held is None:
            large.by_class[own] = places
        else:
            for place in places:
                insort(held, place)
    return large


def maximal_pairs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, shared) of all maximal pairs that satisfy the length constraint, by the tree bottom-up."""
    order = suffix_array(ids).tolist()
    words = ids.tolist()
    before = [-1, *words[:-1]]
    lcp = lcp_values(words, order)
    lcp.append(0)
    least = MIN_LENGTH - 1  # no shorter stretch can be a run's maximal pair
    out: list[tuple[int, int, int]] = []
    open_: list[tuple[Interval, int]] = []  # with the words shared with what follows
    for r, place in enumerate(order):
        follows = lcp[r + 1]
        if follows < least and not open_:
            continue
        node = Interval(place, before[place])
        while open_ and open_[-1][1] >= follows:
            child, shared = open_.pop()
            node = met(child, node, shared, before, out)
        if follows >= least:
            open_.append((node, follows))
    return out


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if len(ids) < MIN_LENGTH or not may_repeat(ids, MIN_LENGTH - 1):
        return []
    found: dict[tuple[int, int], int] = {}
    for i, j, shared in maximal_pairs(ids):
        stretch = (i, j - i + shared)
        if j - i < found.get(stretch, len(ids)):
            found[stretch] = j - i
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: of every run, what follows its first period goes."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(edge).tolist(), strict=False) if not inside]


def describe(text: bytes | None, doc_id: int | None) -> tuple:
    """One row of ``SCHEMA`` without its doc_id."""
    words = rewritten((text or b"").split(), doc_id)  # splits at 0x20 and 0x09 to 0x0D
    found = runs(numbered(words)) if len(words) >= MIN_LENGTH else []
    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return (
        len(words), len(found), *best,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest(),
    )


def find_runs(docs: DataFrame) -> DataFrame:
    """Every row's runs: how many, the longest, and digests of all runs and of the collapsed text.

    ``docs``: doc_id, text.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith("sha256") else pa.int64() for c in names[1:]]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            rows = [describe(t, i) for t, i in zip(utf8(batch.column(1)), ids.to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return on_workers(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
