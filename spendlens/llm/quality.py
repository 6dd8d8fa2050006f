"""Quality classifier with hierarchical empirical Bayes (operator 9).

A document's own evidence is a log-likelihood ratio good / poor: text measures fall into fixed
bins, labelled documents are counted per bin and class (smoothed), and the ratios are averaged
with weights that keep correlated measures from counting twice (``EVIDENCE_WEIGHT``).

Sites add what their other documents show.  Expected good documents are summed over *all*
documents per host and per (host, path) by grouped aggregation.  Two Beta priors are fitted to
the data by moments: hosts around the corpus share, paths around their host's posterior.  A site
with few documents therefore keeps close to the prior above it, a large one follows its own
documents.  A document is judged by its evidence and its path's posterior, each without the
document's own contribution.

``documents`` have no address: the source stands for the host, the language for the path.

Cases: null and empty texts have no words: they fall into the lowest bins and are judged like any
text; null hosts and paths are a host and a path; labels repeated for a document count as good only
if all say so, null labels are left out; without labels of both kinds the evidence is 0 and all rows
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import stage

EVIDENCE_WEIGHT = 0.7
SMOOTHING = 0.5
KEEP_FROM = 0.5
MAX_STRENGTH = 1e4
BROADCAST_SITES = 200_000  # rows of a few numbers and two names

#: upper bin borders of each measure
BINS = {
    "symbol_share": [0.02, 0.05, 0.1, 0.2, 0.4, 0.8],
    "upper_share": [0.05, 0.1, 0.2, 0.35, 0.5, 0.8],
    "mark_share": [0.02, 0.1, 0.3, 0.6, 0.9],
    "pipe_share": [0.02, 0.1, 0.25, 0.4, 0.6],
    "again_share": [0.02, 0.05, 0.1, 0.3, 0.6],
    "distinct_share": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
}


def measures(text: Column) -> list[Column]:
    """Shares of a text's words (or characters), from the whole text."""
    words = F.split(F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))), " ")
    n = F.greatest(F.lit(1), F.size(words)).cast("double")
    gone = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return [
        (gone("#*$%&<>") / n).alias("symbol_share"),
        (F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(F.lit(1), F.length(text))).alias("upper_share"),
        (gone("!?") / n).alias("mark_share"),
        (gone("|") / n).alias("pipe_share"),
        (F.regexp_count(text, F.lit(r"(?<!\S)(\S++) (?=\1(?!\S))")) / n).alias("again_share"),
        (F.size(F.array_distinct(words)) / n).alias("distinct_share"),
    ]


def binned(measure: str) -> Column:
    """The measure's bin: 0 up to the number of borders."""
    bin_ = F.lit(0)
    for border in BINS[measure]:
        bin_ = bin_ + F.when(F.col(measure) > border, 1).otherwise(0)
    return bin_.alias(measure)


def evidence_table(described: DataFrame, labels: DataFrame) -> list[dict]:
    """Per measure and bin the smoothed log ratio of its share among good and poor documents."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    rows = described.join(known, "doc_id")
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in BINS]))
    counts = rows.select("good", stacked.alias("m")).groupBy("m.measure", "m.bin").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("poor")
    )
    return [r.asDict() for r in counts.collect()]  # at most one row per bin


def evidence(counts: list[dict]) -> tuple[Column, float]:
    """(log-likelihood ratio of a described row, share of good labels)."""
    import math

    first = next(iter(BINS))
    good = sum(r["good"] for r in counts if r["measure"] == first)
    poor = sum(r["poor"] for r in counts if r["measure"] == first)
    if not good or not poor:
        return F.lit(0.0), 1.0
    total = F.lit(0.0)
    for m, borders in BINS.items():
        at = {r["bin"]: r for r in counts if r["measure"] == m}
        bins = len(borders) + 1
        share = lambda kind, whole: [
            (at.get(b, {}).get(kind, 0) + SMOOTHING) / (whole + SMOOTHING * bins) for b in range(bins)  # noqa: B023
        ]
        ratios = [math.log(g / p) for g, p in zip(share("good", good), share("poor", poor), strict=True)]
        total = total + F.element_at(F.array(*map(F.lit, ratios)), F.col(m) + 1)
    return total * EVIDENCE_WEIGHT, (good + SMOOTHING) / (good + poor + 2 * SMOOTHING)


def strength(groups: DataFrame, prior: Column) -> float:
    """Beta strength by moments: how far group shares spread around ``prior`` beyond chance.

    ``groups``: n, s.  Var(share) = prior (1 - prior) (1 / n + (1 - 1 / n) / (strength + 1)) in
    expectation, summed over groups with more than one document.
    """
    share, noise = F.col("s") / F.col("n"), prior * (1 - prior)
    row = groups.where("n > 1").agg(
        F.sum(F.pow(share - prior, 2) - noise / F.col("n")).alias("beyond"), F.sum(noise * (1 - 1 / F.col("n"))).alias("whole")
    ).first()
    if not row.whole:
        return MAX_STRENGTH
    rho = row.beyond / row.whole
    return min(MAX_STRENGTH, max(1.0, 1 / rho - 1)) if rho > 0 else MAX_STRENGTH


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, evidence, host_good, path_good, posterior, kept (and ``keep``) for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), *measures(text), *keep)
    own = own.select("doc_id", "host", "path", *map(binned, BINS), *keep)
    described = stage(own.drop(*keep), "described")
    llr, share = evidence(evidence_table(described, labels))
    logit = lambda p: F.log(p / (1 - p))
    good = 1 / (1 + F.exp(-(F.col("evidence") + logit(F.lit(min(share, 1 - 1e-9))))))
    # columns to carry are not written twice: with them the measures are taken again from the text
    rows, out = (x.withColumn("evidence", llr).withColumn("good", good) for x in (described, own if keep else described))

    paths = stage(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(1 - 1e-6, max(1e-6, whole.s / whole.n)) if whole.n else share
    k_host = strength(hosts, F.lit(mean))
    hosts = hosts.withColumn("host_good", (F.col("s") + F.lit(k_host * mean)) / (F.col("n") + F.lit(k_host)))
    shown = paths.join(hosts.select(F.col("host").alias("__host"), "host_good", F.col("n").alias("host_n"), F.col("s").alias("host_s")), F.col("host").eqNullSafe(F.col("__host")))
    k_path = strength(shown, F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("host_good"))))
    sites = shown.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "n", "s", "host_n", "host_s", "host_good")

    # a document's site without the document
    one_host = (F.col("host_s") - F.col("good") + F.lit(k_host * mean)) / (F.col("host_n") - 1 + F.lit(k_host))
    path_good = (F.col("s") - F.col("good") + F.lit(k_path) * one_host) / (F.col("n") - 1 + F.lit(k_path))
    small = paths.count() <= BROADCAST_SITES
    joined = out.join(F.broadcast(sites) if small else sites, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")))
    limited = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), path_good))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + logit(limited))))
    out = joined.select("doc_id", "evidence", "host_good", limited.alias("path_good"), posterior.alias("posterior"), *keep)
    return out.withColumn("kept", F.col("posterior") >= KEEP_FROM)
