"""Classifier with site posteriors: told-apart classes, shrinkage, edge cases."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spendlens.llm import quality
from tests.llm.common import documents, edge_texts, empty, prose


def junk(i):
    return " ".join(w + "$$$" for w in prose(i, 60).split(" "))


def tables(spark, n=300):
    texts = [junk(i) if i % 6 == 0 else prose(i, 60) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic int")
    return texts, labels.withColumn("host", F.lit("clash"))


def test_unlabelled_documents_are_told_apart(spark):
    texts, labels = tables(spark)
    rows = quality.judge(documents(spark, texts), labels).where("doc_id is not null").collect()
    assert {r.doc_id for r in rows if not r.kept} == {i for i in range(300) if i % 6 == 0}


def test_site_evidence_moves_the_verdict(spark):
    rows = [(i, junk(i) if i < 100 else prose(i, 60), "bad" if i < 100 or i % 10 == 0 else "good", "p") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert got[110].evidence == pytest.approx(got[111].evidence)
    assert got[110].path_good < 0.5 < got[111].path_good and got[110].posterior < got[111].posterior


def test_sparse_sites_keep_to_the_prior(spark):
    # one document of a new host: its site posterior is the corpus's, without the document itself
    rows = [(i, prose(i, 60) if i % 4 else junk(i), f"h{i % 5}", "p") for i in range(400)] + [(999, junk(1), "lone", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    lone = quality.judge(docs, labels).where("doc_id = 999").first()
    assert lone.path_good == pytest.approx(0.75, abs=0.05)


def test_odd_tables(spark):
    texts, labels = tables(spark, 60)
    docs = documents(spark)
    assert quality.judge(docs, labels).count() == docs.count()
    carried = quality.judge(docs.withColumn("__row", F.struct(*docs.columns)), labels, keep=("__row",)).select("__row.*")
    assert carried.columns == docs.columns and carried.count() == docs.count()
    assert quality.judge(empty(docs), labels).collect() == []
    assert all(r.kept for r in quality.judge(docs, empty(labels)).collect())
    assert len(quality.judge(documents(spark, edge_texts()), labels.withColumn("quality", F.lit(1))).collect()) == docs.count()


def plain_bins(text):
    text = text or ""
    words = re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ").lower().split(" ")
    n, of = len(words), lambda chars: sum(text.count(c) for c in chars)
    values = {
        "symbol_share": of("#*$%&<>") / n, "upper_share": sum(c.isupper() for c in text) / max(1, len(text)), "mark_share": of("!?") / n,
        "pipe_share": of("|") / n, "again_share": len(re.findall(r"(?<!\S)(\S++) (?=\1(?!\S))", text)) / n, "distinct_share": len(set(words)) / n,
    }
    return {m: sum(v > border for border in quality.BINS[m]) for m, v in values.items()}


def plain_strength(groups):
    """groups: (n, s, prior)."""
    groups = [g for g in groups if g[0] > 1]
    beyond = sum((s / n - p) ** 2 - p * (1 - p) / n for n, s, p in groups)
    whole = sum(p * (1 - p) * (1 - 1 / n) for n, s, p in groups)
    rho = beyond / whole if whole else 0
    return min(quality.MAX_STRENGTH, max(1.0, 1 / rho - 1)) if rho > 0 else quality.MAX_STRENGTH


def plain_judge(rows, labels):
    """rows: (text, host, path); labels: row number -> good."""
    bins, logit = [plain_bins(t) for t, _, _ in rows], lambda p: math.log(p / (1 - p))
    totals = Counter(labels.values())
    counts = {kind: Counter((m, b) for i, good in labels.items() if good == kind for m, b in bins[i].items()) for kind in (1, 0)}
    evidence = []
    for own in bins:
        total = 0.0
        for m, b in own.items():
            share = [(counts[k][m, b] + quality.SMOOTHING) / (totals[k] + quality.SMOOTHING * (len(quality.BINS[m]) + 1)) for k in (1, 0)]
            total += math.log(share[0] / share[1])
        evidence.append(total * quality.EVIDENCE_WEIGHT)
    prior = (totals[1] + quality.SMOOTHING) / (len(labels) + 2 * quality.SMOOTHING)
    good = [1 / (1 + math.exp(-(e + logit(prior)))) for e in evidence]
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, (_, host, path) in enumerate(rows):
        hosts[host].append(i)
        paths[host, path].append(i)
    sums = lambda groups: {g: (len(x), sum(good[i] for i in x)) for g, x in groups.items()}
    host_sums, path_sums, mean = sums(hosts), sums(paths), sum(good) / len(good)
    k_host = plain_strength([(n, s, mean) for n, s in host_sums.values()])
    k_path = plain_strength([(n, s, (host_sums[h][1] + k_host * mean) / (host_sums[h][0] + k_host)) for (h, _), (n, s) in path_sums.items()])
    out = []
    for i, (_, host, path) in enumerate(rows):
        others = lambda found, k, above: (found[1] - good[i] + k * above) / (found[0] - 1 + k)  # noqa: B023, E731
        site = others(path_sums[host, path], k_path, others(host_sums[host], k_host, mean))
        out.append((evidence[i], site, 1 / (1 + math.exp(-(evidence[i] + logit(site))))))
    return out


def test_posteriors_equal_a_plain_version(spark):
    import random

    draw, rows = random.Random(11), []
    for i in range(240):
        host, path = f"h{min(draw.randrange(9), 5)}", draw.choice(["p", "q", None])
        poor = draw.random() < (0.7 if host == "h1" else 0.2 if path == "p" else 0.05)
        text = draw.choice([junk(i), prose(i, 30).upper(), "x y " * 20, prose(i, 20).replace(" ", " | ")]) if poor else prose(i, draw.randint(1, 60))
        rows.append((text if i % 40 else None, host if i % 17 else None, path, int(not poor)))
    docs = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, r[3], 0) for i, r in enumerate(rows) if i % 3], "doc_id long, quality int, toxic int")
    want = plain_judge([r[:3] for r in rows], {i: r[3] for i, r in enumerate(rows) if i % 3})
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    for i, (evidence, site, posterior) in enumerate(want):
        assert (got[i].evidence, got[i].path_good, got[i].posterior) == pytest.approx((evidence, site, posterior), abs=1e-9)
        assert got[i].kept == (posterior >= quality.KEEP_FROM)
