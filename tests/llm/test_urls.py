"""Host rules against a plain loop; the models told apart; edge cases."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from spendlens.llm import urls
from tests.llm.common import CLASH


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def table(spark, values):
    from pyspark.sql import functions as F

    rows = [(i, u, "<p>x</p>") for i, u in enumerate(values)] + [(0, values[0], "again")] if values else []
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("clash") for c in CLASH + ["rule", "verdict", "ratio"]})


ODD = [
    None, "", "no scheme", "http://", "http://COM", "http://com/", "HTTP://A.Com/x?y#z", "x://example.com/en/1", "x://EXAMPLE.com/en/?a",
    "x://www.example.com/en/2", "x://a.www.example.com/en/", "x://net/es/", "x://a.net/fr/x#y", "x://a.net/fr", "x://internet/es/", "a://b://c.com/d",
    "x://com?/x", "x://é.ÀB.com/ü", "x://b.net/de/\n/es/", "x://long.org/" + "a" * 20000,
]


def test_rules_equal_a_plain_loop(spark):
    many = ODD + [f"http://h{i}.example.org/x/{i}" for i in range(30)] + [f"http://h{i}.com/{i}" for i in range(30)]
    rows = urls.judge_urls(table(spark, many)).collect()
    assert len(rows) == len(many) + 1
    for r in rows:
        host, path, rule, verdict = plain(many[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), many[r.page_id]
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_models_tell_undecided_urls_apart(spark):
    r = random.Random(1)
    name = lambda letters: "".join(r.choice(letters) for _ in range(8))
    good = [f"http://{name('aeiouk')}.com/{name('aeiouk')}" for _ in range(200)]
    bad = [f"http://{name('xzqwvj')}.net/es/{name('xzqwvj')}" for _ in range(200)]
    open_ = [(f"http://{name('aeiouk')}.org/{name('aeiouk')}", "allow") for _ in range(40)] + [(f"http://{name('xzqwvj')}.org/{name('xzqwvj')}", "block") for _ in range(40)]
    values = good + bad + [u for u, _ in open_]
    rows = {x.page_id: x for x in urls.judge_urls(table(spark, values)).collect()}
    right = sum(rows[400 + i].verdict == v for i, (_, v) in enumerate(open_))
    assert right >= 76


def own(url):
    """The URL without its scheme and the longest host and path that any rule names."""
    host, path, _, _ = plain(url)
    rest = url.split("://", 1)[1] if "://" in url else url
    named = max([len(h) for _, h, _ in urls.RULES if host == h or host.endswith("." + h)], default=0)
    begun = max([len(p) for _, _, p in urls.RULES if path.startswith(p)], default=0)
    return host[: len(host) - named] + rest[len(host) + begun :]


class Plain:
    """Dictionaries over all contexts."""

    def __init__(self, texts):
        self.pair, self.before = Counter(), Counter()
        for t in texts:
            b = b"\0" * urls.ORDER + t.encode()
            for i in range(urls.ORDER, len(b)):
                for k in range(urls.ORDER + 1):
                    self.before[b[i - k : i], k] += 1
                    self.pair[b[i - k : i + 1], k] += 1

    def knows(self, byte):
        return self.pair[bytes([byte]), 0] >= urls.LEAST

    def log(self, text, known):
        b, total = b"\0" * urls.ORDER + text.encode(), 0.0
        seen = lambda c: c if c >= urls.LEAST else 0
        for i in range(urls.ORDER, len(b)):
            if b[i] not in known:
                continue
            p = 1 / urls.ALPHABET
            for k in range(urls.ORDER + 1):
                here, whole = seen(self.pair[b[i - k : i + 1], k]), seen(self.before[b[i - k : i], k])
                p = (here + urls.PULL * p) / (max(here, whole) + urls.PULL)
            total += math.log(p)
        return total


def test_ratio_equals_plain_dictionaries(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(1, 9)))
    values = ODD[:-1] + [f"http://{word()}.{r.choice(['com', 'net', 'org', 'example.com'])}/{r.choice(['en', 'es', 'fr', 'de'])}/{word()}?{word()}" for _ in range(300)]
    rows = {x.page_id: x for x in urls.judge_urls(table(spark, values)).collect()}
    decided = [(own(u), plain(u)[3]) for u in [*values, values[0]] if u is not None and plain(u)[2]]
    good, bad = (Plain([t for t, v in decided if v == side]) for side in ("allow", "block"))
    for i, u in enumerate(values):
        text = own(u) if u is not None else ""
        known = {c for c in text.encode() if good.knows(c) or bad.knows(c)}
        want = (good.log(text, known) - bad.log(text, known)) / max(1, sum(c in known for c in text.encode()))
        assert abs(rows[i].ratio - want) < 1e-4, u


def test_threshold_has_the_best_balanced_accuracy(spark):
    r = random.Random(2)
    values = [(i % 3 > 0, r.gauss(0.3 if i % 3 else -0.2, 0.4)) for i in range(900)]
    border = urls.threshold(spark.createDataFrame(values, "accepted boolean, ratio double"))
    step = [(a, max(-urls.GRID, min(urls.GRID, math.floor(x * 100))) / 100) for a, x in values]

    def balanced(b):
        good, bad = [x for a, x in step if a], [x for a, x in step if not a]
        return sum(x >= b for x in good) / len(good) + sum(x < b for x in bad) / len(bad)

    assert abs(balanced(border) - max(balanced(k / 100) for k in range(-urls.GRID, urls.GRID + 1))) < 1e-9


def test_rules_strings_are_not_learned(spark):
    """URLs that differ only in hosts and paths that rules name have the same ratio, decided or not."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    values = [f"http://{word()}.com/{word()}" for _ in range(200)] + [f"http://{word()}.net/es/{word()}" for _ in range(200)]
    alike = [u for _ in range(30) for h, p in [(word(), word())] for u in (f"http://{h}.net/en/{p}", f"http://{h}.net/es/{p}", f"http://{h}.com/fr/{p}", f"http://{h}.net/{p}")]
    rows = {x.page_id: x.ratio for x in urls.judge_urls(table(spark, values + alike)).collect()}
    for i in range(0, len(alike), 4):
        assert len({round(rows[400 + i + k], 9) for k in range(4)}) == 1


def test_bounded_models_keep_the_frequent_contexts(spark):
    decided = spark.createDataFrame([(f"ab{i % 5}cd{i}", i % 2 == 0) for i in range(300)], "url string, accepted boolean")
    few, all_ = urls.models(decided, 200), urls.models(decided)
    count = lambda m: sum(len(k) for k, _ in m.tables.values())
    assert 0 < count(few) <= 200 < count(all_)
    assert min(n.min() for _, n in few.tables.values() if len(n)) > min(n.min() for _, n in all_.tables.values())


def test_one_class_and_empty_table(spark):
    rows = urls.judge_urls(table(spark, ["http://a.com/", "http://b.org/"])).collect()
    assert {r.verdict for r in rows} == {"allow"}
    assert urls.judge_urls(table(spark, ["http://a.com/"]).where("false")).collect() == []


def test_counts_beyond_the_bound_take_part(spark):
    """Models that do not fit the tasks score like those that do: nothing is dropped."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 9)))
    values = ODD[:-1] + [f"http://{word()}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'es', 'fr'])}/{word()}" for _ in range(300)]
    pages = table(spark, [*values, "http://" + "ab" * 9000 + ".org/"])
    few, all_ = (sorted(tuple(x) for x in urls.judge_urls(pages, most=most).select("page_id", "verdict", F.round("ratio", 9)).collect()) for most in (150, urls.ENTRIES))
    assert few == all_ and len(few) == pages.count()
