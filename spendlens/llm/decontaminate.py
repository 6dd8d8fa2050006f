"""Benchmark decontamination with a distributed positional inverted index (operator 4).

The training text is indexed in segments, as search engines do: a segment covers a bounded run of
documents and holds, for every term of the test set, the sorted list of that term's places in the
segment.  A place is a running word number over the segment's documents with a gap between
documents, so no match crosses a border.  Segments are rows of a table in the shared folder;
nothing is shuffled, and a segment is searched by whichever task reads it.

A query is a window of ``WINDOW`` consecutive words of a test item (an item of fewer words is one
window).  In a segment the windows that lack a term there end at once; for the others the terms
are taken from the rarest up: the rarest list gives starts, each further list, shifted by the
term's offset, is intersected with them.  ``slop = 0`` gives exact phrases; ``slop = s`` gives proximity
matches: some start exists from which every term stands up to s places from its place in the phrase.

The test set travels to all tasks, so its size is checked: a set beyond ``BLOCK_WORDS`` words is
searched in several blocks, one pass over the data each.  A block is counted, built, sent, searched, its hits
stored and then released before the next one, so the driver holds one block at a time (some 100 bytes a
word); the hits are merged per document.

Exact matches give the hits; a second search of the same lists with ``NEAR`` places of play lists the items that
proximity finds as well.

Cases: null or empty texts have no words and no hits; items without words have no window; an item
with a null id marks words but is neither counted nor listed; rows that repeat a doc_id are
documents of their own; rows that repeat an item id are one item; empty tables give no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import ALNUM_WORDS, chunks, hash_words, on_workers, release, stage, utf8

WINDOW = 10
SEGMENT_BYTES = 4 << 20
BLOCK_WORDS = 2_000_000
NEAR = 2

SEGMENTS = (
    "doc_id array<long>, n_words array<int>, first array<int>, terms array<int>, list_end array<int>, places array<int>"
)


class TestSet:
    """The windows of the test items over a sorted dictionary of their terms."""

    def __init__(self, items: list[tuple[object, bytes]], size: int = WINDOW):
        ids, texts = [i for i, _ in items], [t for _, t in items]
        words, offsets = hash_words(texts, ALNUM_WORDS) if texts else (np.empty(0, np.uint64), np.zeros(1, np.int64))
        self.dictionary, term = np.unique(words, return_inverse=True)
        rows, owner = [], []
        for k in range(len(texts)):
            own = term[offsets[k] : offsets[k + 1]]
            if len(own) == 0:
                continue
            span = min(size, len(own))
            cut = np.lib.stride_tricks.sliding_window_view(own, span)
            padded = np.full((len(cut), size), -1, np.int64)
            padded[:, :span] = cut
            rows.append(padded)
            owner += [k] * len(cut)
        self.windows = np.concatenate(rows) if rows else np.empty((0, size), np.int64)
        self.length = (self.windows >= 0).sum(axis=1)
        self.owner = np.array(owner, np.int64)
        self.ids = ids


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()


def block_of(items: DataFrame, n: int, k: int) -> list[tuple[object, bytes]]:
    """Block ``k`` of ``n`` of the test items."""
    rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
    return [(r.item_id, r.text.encode()) for r in sorted(rows, key=lambda r: (str(r.item_id), r.text))]


def index(docs: DataFrame, dictionary: np.ndarray, gap: int) -> DataFrame:
    """Positional inverted index segments of ``docs`` (doc_id, text) for the terms of ``dictionary``."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionary)

    def segment(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        terms = sent.value
        hashes, offsets = hash_words(texts, ALNUM_WORDS)
        counts = np.diff(offsets)
        first = np.cumsum(counts + gap) - (counts + gap)
        where = np.searchsorted(terms, hashes)
        known = np.zeros(len(hashes), bool)
        if len(terms):
            where[where == len(terms)] = 0
            known = terms[where] == hashes
        at = np.flatnonzero(known)
        doc = np.searchsorted(offsets, at, side="right") - 1
        place = at - offsets[doc] + first[doc]
        order = np.argsort(where[at], kind="stable")
        own, sizes = np.unique(where[at], return_counts=True)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.record_batch(
            [
                pa.ListArray.from_arrays([0, len(ids)], ids), one(counts.astype(np.int32), pa.int32()),
                one(first.astype(np.int32), pa.int32()), one(own.astype(np.int32), pa.int32()),
                one(np.cumsum(sizes).astype(np.int32), pa.int32()), one(place[order].astype(np.int32), pa.int32()),
            ],
            names=["doc_id", "n_words", "first", "terms", "list_end", "places"],
        )

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for low, texts in chunks(utf8(batch.column(1)), SEGMENT_BYTES):
                yield segment(ids.slice(low, len(texts)), texts)

    return on_workers(docs).select("doc_id", "text").mapInArrow(run, SEGMENTS)


def search(test: TestSet, terms: np.ndarray, list_end: np.ndarray, places: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every match in one segment."""
    begin = np.zeros(len(list_end), np.int64)
    begin[1:] = list_end[:-1]
    row_of = np.full(len(test.dictionary) + 1, -1, np.int64)  # the last stands for a window's missing words
    row_of[terms] = np.arange(len(terms))
    count = np.zeros(len(test.dictionary) + 1, np.int64)
    count[terms] = list_end - begin
    in_window = test.windows >= 0
    often = np.where(in_window, count[test.windows], np.iinfo(np.int64).max)
    alive = np.flatnonzero(often.min(axis=1) > 0) if len(often) else np.empty(0, np.int64)
    if len(alive) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by_rarity = np.argsort(often[alive], axis=1, kind="stable")
    key = (np.repeat(np.arange(len(terms)), list_end - begin) << 32) + places + slop
    rarest = by_rarity[:, 0]
    row = row_of[test.windows[alive, rarest]]
    sizes = list_end[row] - begin[row]
    window = np.repeat(np.arange(len(alive)), sizes)
    within = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = places[np.repeat(begin[row], sizes) + within].astype(np.int64) - np.repeat(rarest, sizes)
    if slop:  # the rarest term may be out of its place as well
        window = np.repeat(window, 2 * slop + 1)
        start = np.repeat(start, 2 * slop + 1) + np.tile(np.arange(-slop, slop + 1), len(start))
    for step in range(1, test.windows.shape[1]):
        if len(window) == 0:
            break
        offset = by_rarity[window, step]
        term = test.windows[alive[window], offset]
        r = row_of[term]
        low = (r << 32) + start + offset  # the list is shifted by slop, so this is the lower bound
        at = np.searchsorted(key, low)
        hit = key[np.minimum(at, len(key) - 1)]
        ok = (term < 0) | ((at < len(key)) & (hit >= low) & (hit <= low + 2 * slop))
        window, start = window[ok], start[ok]
    return alive[window], start


def _lists(segment: pa.RecordBatch, row: int, test: TestSet, slop: int) -> tuple[list[list], list[set]]:
    """Per document of a segment the (start, end) runs of its hit words and the hit items' names."""
    one = lambda c: segment.column(c)[row].values.to_numpy(zero_copy_only=False)
    first = one("first").astype(np.int64)
    window, start = search(test, one("terms"), one("list_end").astype(np.int64), one("places"), slop)
    end = start + test.length[window]
    # a near match may begin before its document or end after it; its words lie inside, and gaps are wider than its play
    doc = np.maximum(np.searchsorted(first, start + slop, side="right") - 1, 0)
    order = np.lexsort((start, doc))
    doc, start, end, item = doc[order], start[order], end[order], test.owner[window[order]]
    runs: list[list] = [[] for _ in first]
    names: list[set] = [set() for _ in first]
    for d, s, e, i in zip(doc.tolist(), start.tolist(), end.tolist(), item.tolist(), strict=True):
        base = int(first[d])
        if runs[d] and s - base <= runs[d][-1][1]:
            runs[d][-1][1] = max(runs[d][-1][1], e - base)
        else:
            runs[d].append([s - base, e - base])
        if test.ids[i] is not None:
            names[d].add(str(test.ids[i]))
    return runs, names


MARKS = "doc_id long, n_words long, runs array<array<int>>, items array<string>, near array<string>"


def marks(segments: DataFrame, sent, slop: int = 0, near: int = NEAR) -> DataFrame:
    """Per document: n_words, the hit words as (start, end) runs, the hit items, and those that proximity finds.

    ``sent``: the broadcast ``TestSet``.
    """

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                runs, names = _lists(batch, row, sent.value, slop)
                _, close = _lists(batch, row, sent.value, near)
                texts = pa.list_(pa.string())
                yield pa.record_batch(
                    [
                        batch.column("doc_id")[row].values, batch.column("n_words")[row].values.cast(pa.int64()),
                        pa.array(runs, pa.list_(pa.list_(pa.int32()))), pa.array([sorted(x) for x in names], texts),
                        pa.array([sorted(x) for x in close], texts),
                    ],
                    names=["doc_id", "n_words", "runs", "items", "near"],
                )

    return on_workers(segments).mapInArrow(run, MARKS)


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS, near: int = NEAR
) -> DataFrame:
    """Marks (``MARKS``) of every row of ``docs`` (doc_id, text) against every item of ``benchmark``.

    One block of test items is the rule.  With more, documents are numbered once, so equal doc_ids stay apart.
    """
    spark, items = docs.sparkSession, items_of(benchmark)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (block_words * 5)))
    gap = window + 2 * max(slop, near) + 1

    def searched(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        test = TestSet(block_of(items, blocks, k), window)
        segments = stage(index(rows, test.dictionary, gap), "postings")
        return marks(segments, spark.sparkContext.broadcast(test), slop, near), segments

    if blocks == 1:
        return searched(docs, 0)[0]
    numbered = stage(docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "text"), "numbered")
    rows = numbered.select(F.col("__row").alias("doc_id"), "text")
    merged = None
    for k in range(blocks):
        found, segments = searched(rows, k)
        # the first block's marks hold every document
        found = stage(found if k == 0 else found.where(F.size("runs") + F.size("near") > 0), "marks")
        release(segments)
        merged = found if merged is None else merged.unionAll(found)
    together = lambda c: F.flatten(F.collect_list(c)).alias(c)
    merged = merged.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), together("runs"), together("items"), together("near"))
    whole = merged.withColumnRenamed("doc_id", "__row").join(numbered.select("__row", "doc_id"), "__row")
    return whole.select("doc_id", "n_words", join_runs("runs").alias("runs"), "items", "near")


def join_runs(runs: str):
    """Overlapping or touching (start, end) runs joined; a document's runs per block are disjoint already."""
    step = lambda acc, r: F.when(
        (F.size(acc) > 0) & (F.get(F.element_at(acc, -1), F.lit(1)) >= F.get(r, F.lit(0))),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.array(F.get(F.element_at(acc, -1), F.lit(0)), F.greatest(F.get(F.element_at(acc, -1), F.lit(1)), F.get(r, F.lit(1))))),
        ),
    ).otherwise(F.concat(acc, F.array(r)))
    return F.aggregate(F.sort_array(runs), F.expr("cast(array() as array<array<int>>)"), step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The report of operator 4: one row per row of ``docs``; ``n_near`` counts the items that proximity finds."""
    marked = find_passages(docs, benchmark, window, 0, block_words)
    names = F.array_sort(F.array_distinct("items"))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + F.get(r, F.lit(1)) - F.get(r, F.lit(0)))
    return marked.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
        F.size(F.array_distinct("near")).cast("long").alias("n_near"),
    )
