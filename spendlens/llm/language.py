"""Language identification, words first, then shorter and shorter character n-grams (operator 13).

Learning counts every word of every learned document per language (tasks add up what they hold, Spark adds
the rest).  The n-grams of 1 to ``LONGEST`` characters are counted over that vocabulary, each distinct word
of a language once: unseen words look like the rare ones, not like the frequent ones.  Words are marked
with a blank on either side, so beginnings and ends count.

A text's words each add one log frequency per language: a known word its own, log((n + a) / (N + a V)); an
unseen word the mean over its known n-grams of the greatest length that has any; a word without a known
character adds nothing.  With the log share of learned documents this is a posterior: its largest entry
is the prediction, its value the score.

The model is sent to every task, so its size is bounded: at most ``CELLS`` numbers for words and as many for
n-grams.  A grouped histogram of the counts (all of them) gives the smallest count that keeps within the
bound; rarer words are unseen words.

Cases: a null text, or one without a letter, is ``und`` with score 0; a text whose characters were never seen
gets the most frequent language; with nothing to learn from every row is ``und``; documents with a null
lang are not learned from, nor are rows with a null doc_id, which are not held out either; ties go to the
smaller language name; repeated rows are learned from and answered each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import on_workers, stage

LONGEST = 4
PSEUDO = 0.5
LEAST = 2  # a word or n-gram seen once tells nothing
CELLS = 1 << 20  # numbers per table (terms times languages)
HELD = 300_000  # counters are handed on beyond this many entries
CACHE = 200_000  # unseen words whose n-gram score a worker remembers
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased stretches of letters."""
    return WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower())


def grams(word: str, size: int) -> list[str]:
    """The word's n-grams; a single character stands alone, longer ones may hold the mark at either end."""
    marked = word if size == 1 else f" {word} "
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _rows(counters: dict[str, Counter]) -> pa.RecordBatch:
    terms = list(chain.from_iterable(c.keys() for c in counters.values()))
    langs = list(chain.from_iterable([lang] * len(c) for lang, c in counters.items()))
    counts = list(chain.from_iterable(c.values() for c in counters.values()))
    return pa.record_batch([pa.array(terms, pa.string()), pa.array(langs, pa.string()), pa.array(counts, pa.int64())], names=["term", "lang", "n"])


def counted(parts: DataFrame) -> DataFrame:
    """(term, total, counts [(lang, n)]) from partial counts (term, lang, n), with one shuffle."""
    # dealt by term alone, so the grouping by language and the one over languages stay in place
    each = parts.repartition("term").groupBy("term", "lang").agg(F.sum("n").alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("counts"))


def word_counts(learned: DataFrame) -> DataFrame:
    """Every word of ``learned`` (text, lang) with its counts per language."""

    def run(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text.as_py()))
                if sum(map(len, held.values())) > HELD:
                    yield _rows(held)
                    held = {}
        if held:
            yield _rows(held)

    return counted(on_workers(learned).select("text", "lang").mapInArrow(run, "term string, lang string, n long"))


def gram_counts(vocabulary: DataFrame) -> DataFrame:
    """Every n-gram of the vocabulary, counted once per word and language."""

    def run(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            for word, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(chain.from_iterable(grams(word, size) for size in range(1, LONGEST + 1)))
                for lang in counts:
                    held.setdefault(lang, Counter()).update(own)
                if sum(map(len, held.values())) > HELD:
                    yield _rows(held)
                    held = {}
        if held:
            yield _rows(held)

    names = vocabulary.select("term", F.col("counts.lang").alias("langs"))
    return counted(on_workers(names).mapInArrow(run, "term string, lang string, n long"))


def kept_terms(terms: DataFrame, most: int) -> DataFrame:
    """The terms seen at least ``LEAST`` times, with a larger least count if more than ``most`` remain."""
    step = F.floor(F.log2("total") * 8)
    steps = terms.where(F.col("total") >= LEAST).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 8 * 64
    room, cut = most, None
    for r in sorted(steps, key=lambda r: -r.step):
        room -= r.n
        if room < 0:
            break
        cut = r.step
    return terms.where((F.col("total") >= LEAST) & (step >= cut) if cut is not None else F.lit(False))


class Model:
    """Log frequencies of words and n-grams per language."""

    def __init__(self, langs: list[str], prior: np.ndarray) -> None:
        self.langs, self.prior = langs, prior
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        self.word_logs = self.gram_logs = np.zeros((0, len(langs)), np.float32)
        self.seen: dict[str, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def unseen(self, word: str) -> list[int]:
        """Places of the word's longest known n-grams; none without a known character."""
        found = self.seen.get(word)
        if found is None:
            for size in range(min(LONGEST, len(word) + 2), 0, -1):
                found = [at for g in grams(word, size) if (at := self.grams.get(g)) is not None]
                if found:
                    break
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[word] = found
        return found

    def judge(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text)) if text else Counter()
        if not self.langs or not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
            return UNKNOWN, 0.0
        total = self.prior.copy()
        places, counts, pieces, weights = [], [], [], []
        for word, n in words.items():
            at = self.words.get(word)
            if at is not None:
                places.append(at)
                counts.append(n)
            elif found := self.unseen(word):
                pieces += found
                weights += [n / len(found)] * len(found)
        if places:
            total += np.array(counts, np.float64) @ self.word_logs[places]
        if pieces:
            total += np.array(weights) @ self.gram_logs[pieces]
        best = int(total.argmax())
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def logs_of(terms: DataFrame, kept: DataFrame, langs: list[str], kinds: Column) -> tuple[list[str], np.ndarray]:
    """Terms and their log frequencies; ``kinds`` tells the tables apart that add up to one (n-gram lengths)."""
    each = terms.select(kinds.alias("kind"), "term", F.explode("counts").alias("c"))
    sums = each.groupBy("kind", "c.lang").agg(F.sum("c.n").alias("n")).collect()  # one row per kind and language
    sizes = {r.kind: r.n for r in terms.groupBy(kinds.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    at = {lang: i for i, lang in enumerate(langs)}
    whole = {kind: np.zeros(len(langs)) for kind in sizes}
    for r in sums:
        whole[r.kind][at[r.lang]] = r.n
    rows = kept.select(kinds.alias("kind"), "term", "counts").toArrow()  # at most CELLS / languages rows
    names, kind_of = rows.column("term").to_pylist(), rows.column("kind").to_pylist()
    counts = np.zeros((len(names), len(langs)))
    lists = rows.column("counts").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    if len(names):
        inner = lists.flatten()
        row = np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy(zero_copy_only=False))
        counts[row, [at[x] for x in inner.field("lang").to_pylist()]] = inner.field("n").to_numpy(zero_copy_only=False)
        below = np.array([whole[k] + PSEUDO * sizes[k] for k in kind_of])
        return names, np.log((counts + PSEUDO) / below).astype(np.float32)
    return names, counts.astype(np.float32)


def learn(learned: DataFrame) -> Model:
    """The model of ``learned`` (text, lang); both without nulls."""
    shares = {r.lang: r.n for r in learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    langs = sorted(shares)
    whole = sum(shares.values()) + len(langs)
    model = Model(langs, np.array([math.log((shares[x] + 1) / whole) for x in langs]))
    if not langs:
        return model
    most = CELLS // len(langs)
    vocabulary = stage(word_counts(learned), "vocabulary")
    pieces = stage(gram_counts(vocabulary), "grams")
    names, model.word_logs = logs_of(vocabulary, kept_terms(vocabulary, most), langs, F.lit(0))
    model.words = {w: i for i, w in enumerate(names)}
    names, model.gram_logs = logs_of(pieces, kept_terms(pieces, most), langs, F.length("term"))
    model.grams = {w: i for i, w in enumerate(names)}
    return model


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, lang_pred and score of every row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            rows = [sent.value.judge(text.as_py()) for text in batch.column("text")]
            columns = [batch.column(c) for c in keep]
            columns += [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
            yield pa.record_batch(columns, names=[*keep, "lang_pred", "score"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "lang_pred string", "score double"])
    return on_workers(docs).select("text", *keep).mapInArrow(run, schema)


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score.  ``docs``: doc_id, text, lang; one fold in four is held out."""
    rest = fold(F.col("doc_id"))
    model = learn(docs.where((rest != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang"))
    rows = docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model, ("doc_id", "held_out"))
