"""Digests that share a number."""

from pyspark.sql import functions as F

from emberline.llm import numbering
from emberline.llm.embedding_dedup import near_vectors
from emberline.llm.minhash_forest import near_duplicates


def test_digests_that_share_a_number_get_their_own(spark, monkeypatch):
    monkeypatch.setattr(numbering, "_number", lambda: F.pmod(F.xxhash64("digest"), F.lit(7)))
    distinct = spark.range(60).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("digest"))
    numbers = numbering.Numbers(distinct)
    rows = numbers.add(distinct.unionAll(distinct)).collect()
    of = {}
    for x in rows:
        of.setdefault(bytes(x["digest"]), set()).add(x["class"])
    assert len(rows) == 120 and len(of) == 60 and all(len(v) == 1 for v in of.values())
    assert len(set().union(*of.values())) == 60
    assert numbering.Numbers(distinct.limit(0)).shared is None


def test_results_do_not_depend_on_the_numbers(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[k : k + 60]) for k in range(0, 300, 20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:5] + [texts[0] + " end", "", None])], "doc_id long, text string")
    vecs = spark.createDataFrame([(i, "ab"[i % 2], [float(i % 5), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, label string, embedding array<double>")
    plain = [sorted(near_duplicates(docs).collect()), sorted(near_vectors(vecs).collect())]
    monkeypatch.setattr(numbering, "_number", lambda: F.pmod(F.xxhash64("digest"), F.lit(7)))
    assert [sorted(near_duplicates(docs).collect()), sorted(near_vectors(vecs).collect())] == plain
