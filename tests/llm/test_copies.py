"""The copies that mixing gives against the targets of its rates."""

import pytest
from pyspark.sql import functions as F

from emberline.llm import soft_mixing


def test_copies_meet_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    mixer = soft_mixing.fit_mixer(docs, labels, {"toxic": 1.0, "low": 0.8, "high": 1.2}, relative=True)
    # many ids for each text, so that the draws even out
    many = docs.crossJoin(spark.range(8).withColumnRenamed("id", "k")).select((F.col("doc_id") * 8 + F.col("k")).alias("doc_id"), "text")
    out = soft_mixing.mix(many, mixer, ["doc_id"])
    of = lambda c, d: F.sum(c * F.col("n_tokens") * F.col(f"p_{d}"))
    r = out.agg(*[f(d).alias(f"{n}_{d}") for d in ("low", "high") for n, f in (("got", lambda d: of(F.col("copies"), d)), ("all", lambda d: of(F.lit(1), d)))]).first()
    assert r.got_low / r.all_low == pytest.approx(0.8, abs=0.05)
    assert r.got_high / r.all_high == pytest.approx(1.2, abs=0.05)
