"""The corpus pipeline: language, near duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents; other columns are ignored.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.hash_tree import shard_rows
from emberline.llm.language_id import identify, remainder, train
from emberline.llm.minhash_forest import near_duplicates
from emberline.llm.positional_index import contamination
from emberline.llm.soft_mixing import fit_mixer, mix
from emberline.plans.scratch import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Change of the expected tokens of each domain: toxic ones go, the rest stays.
WEIGHTS = {"toxic": 0.0, "low": 1.0, "high": 1.0}
#: Pull of the rates towards 1: a document that is clean with some certainty isn't to make up for others.
PULL = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a rejected text goes.

    Rejected is a text that is null or has no letters, or whose calibrated score
    is below the model's bound.  Rows are judged one by one, so repeats stay.
    """
    docs = docs.select(*COLUMNS)
    learn = docs.filter(remainder("doc_id") != 0).select(F.col("doc_id").cast("string").alias("key"), "lang", "text")
    return identify(docs, train(learn), COLUMNS).filter("not rejected").select(*COLUMNS)


def _with_row(docs: DataFrame) -> DataFrame:
    """COLUMNS and _row, the identity of a row: ids may be null or repeated, rows of one id and text are the same."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id, a null id last; rows of one id stand for themselves."""
    docs = _with_row(docs)
    groups = near_duplicates(docs, id_col="_row", words=5, percent=80).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least")
    kept = groups.join(docs.select("_row", "doc_id"), "_row").groupBy("component_id").agg(least).select("least._row")
    return docs.join(kept, "_row").select(*COLUMNS).dropDuplicates(["doc_id", "text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item.

    However long a document is, one whole window (13 words, or a shorter item in
    full) makes it go.  Rows are judged by id and text, so a clean row stays
    whatever others have its id; null and empty texts stay.
    """
    docs = _with_row(docs)
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row").filter("n_hit > 0").select(F.col("doc_id").alias("_row")).distinct()
    return docs.join(found, "_row", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says, in expectation: its copies are drawn by a hash of id and text."""
    docs = docs.select(*COLUMNS)
    mixer = fit_mixer(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), WEIGHTS, relative=True, pull=PULL)
    rated = mix(docs, mixer, COLUMNS).filter("copies > 0")
    return rated.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return shard_rows(docs, shards=8)


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mixture", mixture), ("shard", shard)]

#: Models are trained and documents compared in ways that SQL cannot express; tests/llm/test_stages.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
