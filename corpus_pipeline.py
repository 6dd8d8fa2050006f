"""From ``documents`` to token files: quality, near duplicates, decontamination, mixing, tokens.

Every stage takes what the one before kept and decides on whole rows; all but the last return the
columns of documents.  Between stages the rows are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import decontaminate, mixing, near_dedup, quality, tokens
from spendlens.llm.common import stage, table
from spendlens.llm.queries import tokenizer_path

SHINGLE, PERCENT = 5, 80
#: the SQL for run()'s rows: classifier, sketches and tokenizer have none (see tests/llm/test_pipeline.py)
ORACLE_SQL = None


def _key():
    """A document row's identity: its id and text."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    rows = docs.withColumn("__row", F.struct(*docs.columns))
    judged = quality.judge(rows, table(spark, sf_dir, "labels"), keep=("__row",))
    return judged.where("kept").select("__row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; documents without an id are all kept."""
    found = near_dedup.near_duplicates(docs, SHINGLE, PERCENT)
    gone = stage(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "duplicates")
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # rows that repeat a doc_id are one document; as a rule there are none
    repeated = stage(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    single = left.join(repeated, "doc_id", "left_anti").select(docs.columns)
    return single.unionByName(left.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    keyed = docs.select(_key().alias("doc_id"), "text")
    marked = decontaminate.find_passages(keyed, table(spark, sf_dir, "benchmark"))
    hit = stage(marked.where(F.size("runs") > 0).select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return docs.withColumn("__key", _key()).join(hit, "__key", "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in whole documents: each as often as its taken words, rounded to full copies."""
    taken = mixing.mix(docs.select(_key().alias("doc_id"), "source", "text"))
    copies = F.round(F.avg("taken") / F.greatest(F.lit(1), F.max("size"))).cast("int")
    times = stage(taken.groupBy(F.col("doc_id").alias("__key")).agg(copies.alias("__copies")).where("__copies > 0"), "copies")
    rows = docs.withColumn("__key", _key()).join(times, "__key")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back."""
    return tokens.encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token ids", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
