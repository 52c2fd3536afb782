"""The pipeline's stages, each on what its predecessor kept, and the registered queries."""

import duckdb
import pytest

import corpus_pipeline
from emberline.llm.queries import ORACLES, QUERIES
from emberline.plans.scratch import materialize

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, DATA), name)
        assert docs.columns == before.columns
        assert docs.exceptAll(before.distinct()).count() == 0 or name == "mixture"
        assert docs.select("doc_id").distinct().join(before.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
        kept.append(docs.count())
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] > 0.7 * kept[0]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == kept[-1]


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    cols = sorted(found.columns)
    res = con.execute(ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert sorted(tuple(str(r[c]) for c in cols) for r in found.collect()) == sorted(tuple(str(r[i]) for i in order) for r in res.fetchall())
