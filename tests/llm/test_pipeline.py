"""The pipeline's stages against brute force on a small planted corpus, and the registration."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as C
from tests.llm.common import empty, prose


def corpus(spark, folder):
    clean = [prose(i, 80) for i in range(240)]
    junk = [" ".join(w + "$$$" for w in prose(500 + i, 60).split(" ")) for i in range(60)]
    near = [c.replace(" ", " edit ", 1) for c in clean[:20]]
    leak = prose(9000, 30)
    leaked = [prose(700 + i, 40) + " " + leak + " " + prose(800 + i, 40) for i in range(5)]
    texts = clean + junk + near + clean[20:30] + leaked + [None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 240 <= i < 300), 0) for i in range(0, 300, 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, "nowhere to be found at all in any of the texts")], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return docs


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = corpus(spark, folder)
    out = [docs]
    for _, function in C.STAGES:
        out.append(C.stage(function(spark, out[-1], folder), "test"))
    return folder, out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_decides(stages):
    _, (docs, quality, unique, cleaned, mixed, coded) = stages
    assert all(x.columns == docs.columns for x in (quality, unique, cleaned, mixed))
    assert ids(docs) - ids(quality) >= set(range(240, 300)) and ids(quality) >= set(range(240))
    assert ids(quality) - ids(unique) == (set(range(300, 330)) & ids(quality))
    assert ids(unique) - ids(cleaned) == set(range(330, 335))
    assert ids(mixed) <= ids(cleaned)
    assert coded.agg(F.sum("n_tokens")).first()[0] > 0 and coded.count() == mixed.count()


def test_mixed_sources_come_near_their_targets(stages):
    from spendlens.llm import mixing

    _, (_, _, _, cleaned, mixed, _) = stages
    target = {r.source: r.target for r in mixing.mix(cleaned).groupBy("source").agg(F.first("target").alias("target")).collect()}
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()}
    assert all(abs(got[s] - target[s]) <= 80 for s in target)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_run_equals_the_stages(spark, stages):
    folder, out = stages
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in df.collect())
    assert key(C.run(spark, folder)) == key(out[-1])


def test_stages_take_odd_documents(spark, stages):
    folder, (docs, *_) = stages
    for _, function in C.STAGES:
        assert function(spark, empty(docs), folder).collect() == []
    odd = spark.createDataFrame(
        [(None, None, None, None, None, "x"), (None, prose(1, 50), None, None, 1, "x"), (5, prose(2, 50), "en", "s", 2, "y"), (5, prose(2, 50), "en", "s", 2, "z"), (5, prose(3, 50), "en", "s", 2, "z")],
        "doc_id long, text string, lang string, source string, n_chars long, kept string",
    )
    kept = C.near_dedup_stage(spark, odd, folder)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "None", "None"]
    for name, function in C.STAGES[:-1]:
        assert function(spark, odd, folder).columns == odd.columns, name


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == []
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
