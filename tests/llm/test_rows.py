"""The pipeline's decisions by row, on null and repeated ids."""

import corpus_pipeline

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], KINDS)


def _ids(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def _text(name, n=200):
    return " ".join(f"{name}{k}" for k in range(n))


def test_near_copies_by_row(spark):
    a, b, c, d = (_text(x) for x in "abcd")
    rows = [(None, a), (None, a + " more"), (None, b), (7, c), (7, d), (1, d + " more"), (9, ""), (None, b)]
    kept = [(None, a), (None, a + " more"), (None, b), (7, c), (1, d + " more"), (9, "")]
    got = _ids(corpus_pipeline.near_copies(spark, _docs(spark, rows), ""))
    assert len([x for x in got if x[1].startswith(a)]) == 1
    assert [x for x in got if not x[1].startswith(a)] == sorted((str(i), t) for i, t in kept if not t.startswith(a))


def test_decontaminate_by_row(spark, tmp_path):
    item = _text("item", 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, _text("a")), (5, _text("b")), (6, "")]
    rows = [*clean, (None, "so " + item), (5, item + " end")]
    assert _ids(corpus_pipeline.decontaminate(spark, _docs(spark, rows), str(tmp_path))) == sorted((str(i), t) for i, t in clean)
