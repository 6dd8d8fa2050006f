"""Language ID against a plain re-implementation, held-out accuracy and awkward rows."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spendlens.llm import language as L
from spendlens.llm.queries import op13_language_id
from tests.llm import common

SF = "/root/testdata/sf0.01"


class Plain:
    """Dictionaries and loops, nothing bounded."""

    def __init__(self, rows):
        self.docs = Counter(lang for _, lang in rows)
        self.langs = sorted(self.docs)
        self.words = {x: Counter() for x in self.langs}
        for text, lang in rows:
            self.words[lang].update(self.split(text))
        self.grams = {(n, x): Counter(g for w in self.words[x] for g in L.grams(w, n)) for n in range(1, 5) for x in self.langs}

    @staticmethod
    def split(text):
        return re.findall(r"[^\W\d_]+", text.lower())

    def table(self, kind, lang):
        return self.words[lang] if kind == 0 else self.grams[kind, lang]

    def logs(self, kind, term):
        whole = [self.table(kind, x) for x in self.langs]
        if sum(t[term] for t in whole) < 2:
            return None
        size = len(set().union(*whole))
        return [math.log((t[term] + 0.5) / (sum(t.values()) + 0.5 * size)) for t in whole]

    def word(self, w):
        found = self.logs(0, w)
        for n in range(4, 0, -1):
            if found is None:
                each = [x for x in (self.logs(n, g) for g in L.grams(w, n)) if x]
                found = [sum(c) / len(each) for c in zip(*each)] if each else None
        return found or [0.0] * len(self.langs)

    def judge(self, text):
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0
        total = [math.log((self.docs[x] + 1) / (sum(self.docs.values()) + len(self.langs))) for x in self.langs]
        for w in self.split(text):
            total = [a + b for a, b in zip(total, self.word(w))]
        top = max(total)
        return self.langs[total.index(top)], 1 / sum(math.exp(t - top) for t in total)


def test_equals_plain(spark):
    """Learned and answered on the same small rows: words, backed-off words, unseen characters, prior only."""
    texts = {
        "en": ["the cat of the house", "the dog and the cat", "houses of the and"],
        "fr": ["le chat de la maison", "le chien et le chat", "maisons de la et"],
        "es": ["el gato de la casa", "el perro y la casa"],
    }
    rows = [(t, lang) for lang, own in texts.items() for t in own]
    model = L.learn(spark.createDataFrame(rows, "text string, lang string"))
    plain = Plain(rows)
    asked = ["the cat", "chat chien", "casas perros gatos", "housing catty", "жук", "zzz", "12 34", "", None, "THE Maison", "a", "le y the", "½ ²", "x" * 3000, "e"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df, model, ("doc_id",)).collect()}
    for i, text in enumerate(asked):
        want = plain.judge(text)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-5), text


def test_backoff_goes_from_long_to_short():
    model = L.Model(["a", "b"], L.np.zeros(2))
    model.grams = {"abcd": 0, "ab": 1, "z": 2}
    model.gram_logs = L.np.array([[-1, -2], [-5, -1], [-3, -4]], L.np.float32)
    assert model.unseen("xabcdx") == [0]
    assert model.unseen("xabxab") == [1, 1]
    assert model.unseen("z") == [2] and model.unseen("q") == []
    assert model.judge("xabx")[0] == "b" and model.judge("xabcdx")[0] == "a"


def test_bounded_model_keeps_the_frequent_terms(spark):
    df = spark.createDataFrame([(f"w{i}", i, [("en", i)]) for i in range(1, 200)], "term string, total long, counts array<struct<lang:string,n:long>>")
    kept = {r.total for r in L.kept_terms(df, 50).collect()}
    assert 20 <= len(kept) <= 50 and kept == set(range(min(kept), 200))
    assert L.kept_terms(df, 1000).count() == 198 and L.kept_terms(df, 0).count() == 0


def test_rows_and_cases(spark):
    docs = common.documents(spark)
    got = L.learn_and_identify(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(map(str.isalpha, text[r.doc_id] or "")))
    assert L.learn_and_identify(common.empty(docs)).collect() == []
    unlabelled = L.learn_and_identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unlabelled) == len(got) and {r.lang_pred for r in unlabelled} == {"und"}


def test_labels_of_held_out_rows_and_names_are_never_read(spark):
    """Changing lang of held-out rows, and source and doc_id's fold-mates, changes no prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: (r.lang_pred, r.score) for r in L.learn_and_identify(docs).collect()}
    held = L.fold(F.col("doc_id")) == 2
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in L.learn_and_identify(other).collect()} == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = op13_language_id(spark, SF)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    r = out.join(docs, "doc_id").where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert r[1] > 100 and r[0] > 0.97
