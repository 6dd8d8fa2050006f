"""URL filter: host rules first, then a character language-model ratio (operator 2).

Two character models, one of accepted and one of rejected URLs, are counted over every URL that a
rule decides.  Hosts and beginnings of paths that any rule names are left out of every URL, in counting,
calibration and scoring: they would only teach the models the rules.  Each model mixes contexts of 0 to ``ORDER`` characters: the longest context seen
gives the prediction, drawn towards the next shorter one by ``PULL`` pseudo-counts, down to the
uniform distribution (a smoothed variable-order Markov model).  Counts are exact per context (64-bit hashes),
from one grouped sum over all URLs.  Contexts seen less than ``LEAST`` times are left to shorter ones.  The
``ENTRIES`` most frequent counts, at most 12 bytes * ``ENTRIES`` = 50 MB, are sent to the tasks; if there are more, the
others are joined with the distinct windows of ``ORDER`` + 1 characters, so every count takes part at any size.

A URL's score is its log-likelihood difference (accepted minus rejected) per character that either model knows.  The
threshold is calibrated on URLs that the models did not see: one fold in ``FOLDS`` of the decided
URLs is left out of a first pair of models and scored by it; the border with the best balanced
accuracy is taken from a histogram of those scores.

Cases: a null url, or one without ``://``, has an empty host and path and no rule; its characters
(null: none) are scored like any, none at all scores 0; if one of the classes is missing every
undecided URL is allowed; a URL without a scheme is scored whole; rows that repeat a page_id are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import chunks, mix64, on_workers, release, stage, utf8

ORDER = 5
PULL = 2.0
LEAST = 2
ENTRIES = 1 << 22
FOLDS = 5
ALPHABET = 256
GRID = 400  # histogram steps of 1/100 nat on either side of zero

#: (verdict, host, path): a rule fits its host and all subdomains when the path starts with its path
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        made = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def own_part(url: Column, host: Column, path: Column, rules=RULES) -> Column:
    """The URL after its scheme, without the longest host and the longest beginning of the path that a rule names."""
    longest = lambda names: sorted(set(names), key=lambda x: (-len(x), x))
    named, begun = F.lit(0), F.lit(0)
    for h in reversed(longest(r[1] for r in rules)):
        named = F.when((host == h) | host.endswith("." + h), F.lit(len(h))).otherwise(named)
    for p in reversed(longest(r[2] for r in rules)):
        begun = F.when(path.startswith(p), F.lit(len(p))).otherwise(begun)
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(url)
    after = F.substring(rest, F.length(host) + begun + 1, F.length(rest))
    return F.concat(F.substring(host, F.lit(1), F.length(host) - named), after)


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every character in its contexts of 0..ORDER characters, of the contexts, and the offsets.

    A text is led by its start mark, so the first characters have contexts as well; characters
    beyond the start are as many marks.
    """
    lead = b"\x00" * ORDER
    data = np.frombuffer(b"".join(lead + t for t in texts), np.uint8).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) + np.repeat((np.arange(len(texts)) + 1) * ORDER, lengths)
    pair, before = np.empty((ORDER + 1, len(at)), np.uint64), np.empty((ORDER + 1, len(at)), np.uint64)
    context = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        if k:
            context = mix64(context * np.uint64(0x9E3779B97F4A7C15) + data[at - k] + np.uint64(1))
        own = context + np.uint64(k + 1)
        before[k] = mix64(own)
        pair[k] = mix64(own * np.uint64(0xC2B2AE3D27D4EB4F) + data[at] + np.uint64(7))
    return pair, before, offsets


def count(decided: DataFrame) -> DataFrame:
    """(accepted, kind, key, n): how often each context (kind 1) and each character in it (kind 0) occurs.

    ``decided``: url, accepted (boolean).  Tasks add up what a chunk holds before the shuffle.
    """
    schema = "accepted boolean, kind int, key long, n long"

    def run(batches):
        for batch in batches:
            accepted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for low, texts in chunks(utf8(batch.column(0))):
                own = accepted[low : low + len(texts)]
                for side in (False, True):
                    pair, before, _ = contexts([t for t, a in zip(texts, own, strict=True) if a == side])
                    for kind, keys in enumerate((pair, before)):
                        key, n = np.unique(keys, return_counts=True)
                        size = len(key)
                        yield pa.record_batch(
                            [pa.array(np.full(size, side)), pa.array(np.full(size, kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n)],
                            names=["accepted", "kind", "key", "n"],
                        )

    return on_workers(decided).select("url", "accepted").mapInArrow(run, schema).groupBy("accepted", "kind", "key").agg(F.sum("n").alias("n"))


class Counts:
    """Looks counts up by hash: one sorted table per (accepted, kind)."""

    def __init__(self, tables: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray]]) -> None:
        self.tables = tables

    def of(self, side: int, kind: int, keys: np.ndarray) -> np.ndarray:
        known, n = self.tables[bool(side), kind]
        if not len(known):
            return np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, n[at], np.float32(0))


def models(decided: DataFrame, most: int = ENTRIES) -> Counts:
    """The most frequent counts of both models, at most ``most`` (``split_models`` has the others, too)."""
    return split_models(decided, most)[0]


def split_models(decided: DataFrame, most: int) -> tuple[Counts, DataFrame | None]:
    """The most frequent counts of both models, at most ``most``, and a stage table of all others (None: there are none)."""
    found = stage(count(decided).where(F.col("n") >= LEAST), "url-counts")
    step = F.floor(F.log2("n") * 4)
    sizes = found.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 * 64 rows
    room, cut = most, None
    for r in sorted(sizes, key=lambda r: -r.step):
        room -= r.n
        if room < 0:
            break
        cut = r.step
    frequent = step >= cut if cut is not None else F.lit(False)
    kept = found.where(frequent).toPandas()
    rest = None
    if room < 0:
        rest = stage(found.where(~frequent), "url-rest")
    release(found)
    tables = {}
    for side in (False, True):
        for kind in (0, 1):
            own = kept[(kept.accepted == side) & (kept.kind == kind)]
            key = own["key"].to_numpy().astype(np.int64).view(np.uint64)
            order = np.argsort(key)
            tables[side, kind] = (key[order], own["n"].to_numpy().astype(np.float32)[order])
    return Counts(tables), rest


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every character with the ``ORDER`` before it as one number of ORDER + 1 bytes, and its text's number."""
    lead = b"\x00" * ORDER
    data = np.frombuffer(b"".join(lead + t for t in texts), np.uint8).astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(text)) + (text + 1) * ORDER
    out = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        out = out << 8 | data[at - k]
    return out, text


def gram_texts(gram: np.ndarray) -> list[bytes]:
    """The bytes of each number that ``grams`` gives."""
    raw = gram.astype(">i8").tobytes()
    return [raw[8 * i + 7 - ORDER : 8 * i + 8] for i in range(len(gram))]


def gram_counts(model: Counts, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts [slot, gram] of the last character of each gram, and the slots' keys; slots are (kind, accepted, order)."""
    pair, before, offsets = contexts(gram_texts(gram))
    last = offsets[1:] - 1
    keys = np.stack([k[o, last] for k in (pair, before) for _ in (0, 1) for o in range(ORDER + 1)])
    found = [model.of(side, kind, keys[(2 * kind + side) * (ORDER + 1) + o]) for kind in (0, 1) for side in (0, 1) for o in range(ORDER + 1)]
    return np.stack(found).astype(np.float64), keys


def scored_by_join(urls: DataFrame, model: Counts, rest: DataFrame, keep: list[str]) -> DataFrame:
    """As ``scored``, where ``model`` has the most frequent counts and the stage table ``rest`` all others.

    A character's contribution depends on its window of ORDER + 1 characters alone.  Counts that ``model`` lacks are
    joined with the distinct windows (they are rare, so no key is hot), and the windows' contributions with the rows.
    """
    sent = urls.sparkSession.sparkContext.broadcast(model)
    rows = stage(on_workers(urls).select(F.monotonically_increasing_id().alias("__row"), "url", *keep), "url-rows")

    def windows(batches):
        for batch in batches:
            row = batch.column(0).to_numpy()
            for low, texts in chunks(utf8(batch.column(1))):
                gram, text = grams(texts)
                some, n = np.unique(np.stack([row[low + text], gram]), axis=1, return_counts=True)
                yield pa.record_batch([pa.array(some[0]), pa.array(some[1]), pa.array(n)], names=["__row", "gram", "times"])

    held = stage(rows.select("__row", "url").mapInArrow(windows, "__row long, gram long, times long"), "url-windows")
    distinct = stage(held.select("gram").distinct(), "url-grams")

    def missing(batches):
        for batch in batches:
            gram = batch.column(0).to_numpy()
            counts, keys = gram_counts(sent.value, gram)
            slot, at = np.nonzero(counts == 0)
            side, kind = slot // (ORDER + 1) % 2 == 1, slot // (2 * ORDER + 2)
            yield pa.record_batch(
                [pa.array(gram[at]), pa.array(slot.astype(np.int32)), pa.array(side), pa.array(kind.astype(np.int32)), pa.array(keys[slot, at].view(np.int64))],
                names=["gram", "slot", "accepted", "kind", "key"],
            )

    looked = distinct.mapInArrow(missing, "gram long, slot int, accepted boolean, kind int, key long").join(rest, ["accepted", "kind", "key"])
    found = looked.groupBy("gram").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns"))  # at most one per slot

    def worth(batches):
        for batch in batches:
            gram, slots, ns = batch.column("gram").to_numpy(), batch.column("slots").to_pylist(), batch.column("ns").to_pylist()
            counts, _ = gram_counts(sent.value, gram)
            for i, (s, n) in enumerate(zip(slots, ns, strict=True)):
                if s:
                    counts[s, i] = n
            here, whole = counts.reshape(2, 2, ORDER + 1, -1)
            p = np.full((2, len(gram)), 1.0 / ALPHABET)
            for k in range(ORDER + 1):
                p = (here[:, k] + PULL * p) / (np.maximum(whole[:, k], here[:, k]) + PULL)
            known = here[:, 0].sum(axis=0) > 0
            log = np.where(known, np.log(p[1]) - np.log(p[0]), 0.0)
            yield pa.record_batch([pa.array(gram), pa.array(log), pa.array(known.astype(np.int64))], names=["gram", "log", "known"])

    worths = stage(distinct.join(found, "gram", "left").mapInArrow(worth, "gram long, log double, known long"), "url-worths")
    # decimals: the sum does not depend on the order
    total = F.sum(F.col("log").cast("decimal(25,15)") * F.col("times").cast("int")).cast("double")
    sums = held.join(worths, "gram").groupBy("__row").agg(total.alias("__total"), F.sum(F.col("known") * F.col("times")).alias("__known"))
    ratio = F.coalesce(F.col("__total") / F.greatest("__known", F.lit(1)), F.lit(0.0))
    return rows.join(sums, "__row", "left").select(*keep, ratio.alias("ratio"))


def scored(urls: DataFrame, model: Counts, keep: list[str], rest: DataFrame | None = None) -> DataFrame:
    """``keep`` and the log-likelihood difference per character of column ``url``."""
    if rest is not None:
        return scored_by_join(urls, model, rest, keep)
    sent = urls.sparkSession.sparkContext.broadcast(model)
    kinds = dict(urls.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ratio double"

    def run(batches):
        counts = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for low, texts in chunks(utf8(batch.column("url"))):
                pair, before, offsets = contexts(texts)
                p = np.full((2, pair.shape[1]), 1.0 / ALPHABET)
                # a character that neither model knows tells nothing about either
                known = counts.of(0, 0, pair[0]) + counts.of(1, 0, pair[0]) > 0
                for k in range(ORDER + 1):
                    for side in (0, 1):
                        here, whole = counts.of(side, 0, pair[k]), counts.of(side, 1, before[k])
                        p[side] = (here + PULL * p[side]) / (np.maximum(whole, here) + PULL)
                total = np.concatenate([[0.0], np.cumsum(np.where(known, np.log(p[1]) - np.log(p[0]), 0.0))])
                told = np.concatenate([[0], np.cumsum(known)])
                length = told[offsets[1:]] - told[offsets[:-1]]
                out[low : low + len(texts)] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(length, 1)
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(out)], names=[*keep, "ratio"])

    return on_workers(urls).mapInArrow(run, schema)


def threshold(judged: DataFrame) -> float:
    """The border with the best balanced accuracy over a histogram of (accepted, ratio)."""
    step = F.greatest(F.lit(-GRID), F.least(F.lit(GRID), F.floor(F.col("ratio") * 100)))
    rows = judged.groupBy(step.alias("step")).agg(
        F.sum(F.col("accepted").cast("int")).alias("good"), F.sum((~F.col("accepted")).cast("int")).alias("bad")
    ).collect()  # at most one row per step
    good, bad = np.zeros(2 * GRID + 2), np.zeros(2 * GRID + 2)
    for r in rows:
        good[r.step + GRID], bad[r.step + GRID] = r.good, r.bad
    if not good.sum() or not bad.sum():
        return 0.0
    below_good, below_bad = np.concatenate([[0], np.cumsum(good)[:-1]]), np.concatenate([[0], np.cumsum(bad)[:-1]])
    balanced = below_bad / bad.sum() + 1 - below_good / good.sum()
    best = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    return float((best[len(best) // 2] - GRID) / 100)  # the middle of the best stretch


def judge_urls(pages: DataFrame, rules=RULES, keep: tuple[str, ...] = (), most: int = ENTRIES) -> DataFrame:
    """page_id, host, path, rule, verdict and ratio (and ``keep``) for every row of ``pages`` (page_id, url).

    At most ``most`` counts are sent to the tasks, the others are joined.
    """
    host, path = host_and_path(F.col("url"))
    known = pages.select("page_id", "url", host.alias("host"), path.alias("path"), *keep)
    known = known.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    known = known.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), *keep)
    own = own_part(F.col("url"), F.col("host"), F.col("path"), rules).alias("url")
    decided = stage(
        known.where("rule is not null and url is not null").select(
            own, (F.col("ruled") == "allow").alias("accepted"), F.pmod(F.xxhash64("host"), F.lit(FOLDS)).alias("fold")
        ),
        "decided",
    )
    kinds = {r.accepted for r in decided.select("accepted").distinct().collect()}
    if len(kinds) < 2:
        return known.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("ratio"), *keep)
    tuned, rest = split_models(decided.where("fold != 0"), most)
    border = threshold(scored(decided.where("fold = 0"), tuned, ["accepted"], rest))
    whole, rest = split_models(decided, most)
    names = ["page_id", "host", "path", "rule", "ruled", *keep]
    out = scored(known.select(*names, own), whole, names, rest)
    method = F.when(F.col("ratio") >= border, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "ratio", *keep)
