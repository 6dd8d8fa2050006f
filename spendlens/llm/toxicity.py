"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 5).

Features of a text are the distinct hashes, in ``1 << BITS`` slots, of its words, its pairs of
neighbouring words and its pairs of words with one word between.  FTRL keeps a rate per slot and
an L1 threshold on the summed gradient: a slot seen in few texts never gets a weight, so the model
stays small enough to travel (at most one 4-byte number per slot, whatever the corpus).

Fitting reads a bounded sample of labelled rows (``MAX_LABELLED``), dealt by hash into
groups of about ``SHARD_ROWS`` that train at the same time; a slot's weight is the mean over the groups.

Cases: null and empty texts have no features and get the intercept's score; repeated labels of a
document count as toxic if any says so, null labels are left out; rows with a null doc_id are scored
and counted as not held out; without labels of both kinds every score is the share of toxic labels
(0.0 if there are none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import ALNUM_WORDS, chunks, hash_words, mix64, on_workers, stage, utf8

BITS = 20
MAX_LABELLED = 24_000
SHARD_ROWS = 8_000
EPOCHS = 6
FOLDS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every n-gram, offsets of each text's slots); a slot may repeat within a text."""
    words, offsets = hash_words(texts, ALNUM_WORDS)
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), counts)
    grams, docs = [words], [doc]
    for step, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        same = doc[:-step] == doc[step:] if len(doc) > step else np.empty(0, bool)
        pair = mix64(words[:-step] * np.uint64(0x9E3779B97F4A7C15) + words[step:] * np.uint64(3) + np.uint64(salt))[same] if len(doc) > step else np.empty(0, np.uint64)
        grams.append(pair)
        docs.append(doc[:-step][same] if len(doc) > step else np.empty(0, np.int64))
    slots, owner = np.concatenate(grams) >> np.uint64(64 - BITS), np.concatenate(docs)
    order = np.argsort(owner, kind="stable")
    return slots[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(texts) + 1))


class Ftrl:
    """Per-coordinate FTRL-proximal state; the last slot is the intercept, free of the L1 threshold."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        over = np.abs(z) - np.where(at == 1 << BITS, 0.0, L1)
        return np.where(over > 0, -np.sign(z) * over / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(sample: DataFrame) -> DataFrame:
    """(shard, slot, weight) of each shard's model.  ``sample``: shard, text, toxic, in any order."""

    def fit(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        group = group.sort_by("place")  # by hash, so a rerun learns in the same order
        rows, labels = [], group.column("toxic").to_pylist()
        for _, texts in chunks(utf8(group.column("text"))):
            slots, offsets = features(texts)
            rows += [np.unique(slots[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        model, intercept = Ftrl(), np.array([1 << BITS])
        for _ in range(EPOCHS):
            for at, label in zip(rows, labels, strict=True):
                model.learn(np.concatenate([at, intercept]), float(label))
        every = np.arange((1 << BITS) + 1)
        w = model.weights(every)
        used = np.flatnonzero(w)
        return pa.table({"shard": pa.array(np.full(len(used), shard, np.int32)), "slot": pa.array(used.astype(np.int32)), "weight": pa.array(w[used])})

    return on_workers(sample).groupBy("shard").applyInArrow(fit, "shard int, slot int, weight double")


def margins(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` and the margin of every text: the weights of its distinct slots, summed."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", margin double"

    def run(batches):
        weight = sent.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for low, texts in chunks(utf8(batch.column("text"))):
                slots, offsets = features(texts)
                hit = np.flatnonzero(weight[slots])
                doc = np.searchsorted(offsets, hit, side="right") - 1
                pairs = np.unique((doc << (BITS + 1)) + slots[hit])
                out[low : low + len(texts)] = np.bincount(pairs >> (BITS + 1), weight[pairs & ((1 << (BITS + 1)) - 1)], minlength=len(texts))
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(out)], names=[*keep, "margin"])

    return on_workers(docs).mapInArrow(run, schema)


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold() != 0).withColumn("place", F.xxhash64("doc_id"))
    n = min(known.count(), max_labelled)
    # rows with the smallest hashes, in expectation max_labelled of them
    share = n / max(1, known.count())
    shards = max(1, round(n / shard_rows))
    chosen = known.where(F.shiftrightunsigned("place", 40) < F.lit(int(share * (1 << 24))))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    sample = sample.select("text", "place", F.col("toxic").cast("int").alias("toxic"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"))
    sample = stage(sample, "labelled")
    toxic, total = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    out = docs.select("doc_id", "text", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"))
    if toxic in (0, total):
        flat = float(toxic / total) if total else 0.0
        return out.select("doc_id", "held_out", F.lit(flat).alias("score"), F.lit(int(flat >= 0.5)).alias("predicted"))
    # at most one number per slot
    found = train(sample).groupBy("slot").agg((F.sum("weight") / F.lit(shards)).alias("weight")).toPandas()
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[found.slot.to_numpy()] = found.weight.to_numpy()
    intercept = float(weights[-1])
    scored = margins(out, weights[:-1], ["doc_id", "held_out"])
    score = 1 / (1 + F.exp(-(F.lit(intercept) + F.col("margin"))))
    return scored.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
