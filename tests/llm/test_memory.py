"""Memory of the language stage: what a task holds beside its batch, and what is sent to it."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from emberline.llm import language_id
from emberline.llm import textkit as K


def _model():
    rng = np.random.default_rng(3)
    return language_id.Model(["de", "en", "es", "zh"], rng.normal(size=(len(language_id.ORDERS) << language_id.BITS, 4)).astype(np.float32), np.zeros(4), 1.0, 0.3)


def _texts():
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(x) for x in rng.choice([*range(0x61, 0x7B), 0xE9, 0x4E2D], 6))
    texts = [" ".join(word() for _ in range(n)) for n in rng.integers(1, 250, 1300)]
    texts[5], texts[6], texts[7], texts[8] = None, "", "  a ", "1 2"
    texts[40] = " ".join(texts[41:400])  # longer than a piece
    return texts


def test_language_task_holds_pieces():
    model, texts = _model(), _texts()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "_read"])
    assert batch.nbytes > 1 << 20
    tracemalloc.start()
    got = pa.Table.from_batches(list(language_id._predict(model, 1)(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6

    # the same as all n-grams of a slice at once
    z = []
    for a, b, buf, offs in K.text_slices(batch, "_read"):
        w, full = language_id._weights(buf), np.flatnonzero(np.diff(offs))
        own = np.zeros((b - a, 4))
        one = sum(model.table[g] for g in language_id.ngrams(buf)) * w[:, None]
        own[full] = np.add.reduceat(one, offs[full], axis=0, dtype=np.float64)
        assert (language_id._sums(model, buf, offs, w) == own).all()
        z.append(own)
    letters = np.array([any(c.isalpha() for c in t or "") for t in texts])
    assert got.column("lang_pred").to_pylist() == [model.languages[k] if x else "und" for k, x in zip(np.concatenate(z).argmax(1), letters, strict=True)]


def test_language_stage_sends_a_text_once(spark):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(_texts()[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = language_id.identify(docs, _model(), corpus_pipeline.COLUMNS)
    assert "_read" not in once._jdf.queryExecution().analyzed().toString()
    twice = language_id.identify(docs, _model(), ["doc_id"])
    names = ["doc_id", "lang_pred", "score", "rejected"]
    assert once.columns == [*corpus_pipeline.COLUMNS, *names[1:]]
    assert sorted(once.select(names).collect()) == sorted(twice.select(names).collect())
    assert [tuple(r)[:5] for r in once.orderBy("doc_id").collect()] == rows
    # a kept text of another type is read as a string and kept as it is
    binary = docs.withColumn("text", docs["text"].cast("binary"))
    assert sorted(language_id.identify(binary, _model(), ["doc_id", "text"]).select(names).collect()) == sorted(twice.select(names).collect())
