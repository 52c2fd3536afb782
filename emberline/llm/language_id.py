"""Language identification from averaged hashed subword embeddings.

A text is the average of the embeddings of its byte n-grams (2 to 4 bytes,
hashed); a linear softmax on the average gives the language.  Embeddings and
softmax are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled rows.  Since average and softmax are linear, the
product of both tables is all that prediction needs.

Scores are calibrated with one temperature on rows of the sample kept from
training; the same rows set the score below which a text is rejected.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkit as K

ORDERS, BITS, DIM = (2, 3, 4), 15, 16
#: Labelled rows of each language that training takes, about (a hash decides which); a bound, not a share.
SAMPLE_PER_LANGUAGE = 1000
EPOCHS, RATE = 4, 4.0
#: Share of rightly classified sample rows that rejection may cost.
REJECT_SHARE = 0.001
UNDETERMINED = "und"
#: Bytes of text whose n-grams are looked up at once, by whole documents; it bounds memory and changes no result.
PIECE_BYTES = 1 << 17

_MAP = np.full(256, 0x20, dtype=np.uint8)
_MAP[0x41:0x5B] = np.arange(0x61, 0x7B)
_MAP[0x61:0x7B] = np.arange(0x61, 0x7B)
_MAP[0x80:] = np.arange(0x80, 0x100)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # n-gram buckets x languages
    bias: np.ndarray
    temperature: float
    reject_below: float


def ngrams(buf: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each byte; ends are padded with spaces."""
    x = np.concatenate([_MAP[buf], np.full(max(ORDERS), 0x20, np.uint8)]).astype(np.uint32)
    n, code, out = len(buf), x[: len(buf)].copy(), []
    for j in range(1, max(ORDERS)):
        code = (code << np.uint32(8)) | x[j : n + j]
        if j + 1 in ORDERS:
            k = ORDERS.index(j + 1)
            out.append(((code * _MULT[k]) >> np.uint32(32 - BITS)).astype(np.int64) + (k << BITS))
    return out


def _weights(buf: np.ndarray) -> np.ndarray:
    """1 where an n-gram counts: it doesn't start in a run of what isn't letters."""
    x = _MAP[buf]
    blank = x == 0x20
    w = np.ones(len(buf), np.float32)
    w[:-1][blank[:-1] & blank[1:]] = 0
    if len(w) and blank[-1]:
        w[-1] = 0
    return w


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Language, distinct buckets and their counts of each row."""
    for batch in batches:
        lang, idx, cnt = [], [], []
        names = batch.column(1).to_pylist()
        for a, b, buf, offs in K.text_slices(batch, "text"):
            for i in range(b - a):
                own = buf[offs[i] : offs[i + 1]]
                if not len(own):
                    continue
                w = _weights(own) > 0
                u, c = np.unique(np.concatenate([g[w] for g in ngrams(own)]), return_counts=True)
                lang.append(names[a + i])
                idx.append(u.astype(np.int32).tobytes())
                cnt.append(c.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())], ["lang", "idx", "cnt"])


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def train(labelled: DataFrame, seed: int = 11) -> Model:
    """Fit on columns key, lang, text. Rows without lang or text are left out; no rows give a model without languages.

    The sample is bounded, so one task fits the model and only its tables reach the driver.
    """
    rows = labelled.filter("lang is not null and text is not null and text <> ''")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if languages:
        share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, SAMPLE_PER_LANGUAGE / counts[k]))])
        draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / float(1 << 30)
        # a row that is repeated is drawn as one
        drawn = rows.filter(draw < share[F.col("lang")]).select("key", "lang", "text").dropDuplicates()
        sample = drawn.mapInArrow(_features, "lang string, idx binary, cnt binary")
        for r in sample.repartition(1).mapInArrow(_fit_task(languages, seed), "model binary").collect():
            return pickle.loads(r.model)
    return Model([], np.zeros((len(ORDERS) << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)


def _fit_task(languages: list[str], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        docs = [(languages.index(lang), np.frombuffer(idx, np.int32), np.frombuffer(cnt, np.float32)) for lang, idx, cnt in sorted(rows) if len(idx)]
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(docs, languages, seed))], pa.binary())], ["model"])

    return run


def fit(docs: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], seed: int = 11) -> Model:
    """Gradient descent and calibration on (language, buckets, counts) of documents."""
    rng = np.random.default_rng(seed)
    docs = [docs[i] for i in rng.permutation(len(docs))]
    kept, docs = docs[: len(docs) // 5], docs[len(docs) // 5 :] or docs
    e = rng.normal(0, 0.1, (len(ORDERS) << BITS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for i in rng.permutation(len(docs)):
            y, idx, c = docs[i]
            part = c / c.sum()
            h = part @ e[idx]
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            down = w @ p
            w -= rate * np.outer(h, p) * 0.25
            bias -= rate * 0.01 * p
            e[idx] -= rate * np.outer(part, down)
    table = (e @ w).astype(np.float32)
    z = np.array([(c / c.sum()) @ table[idx] + bias for _, idx, c in kept or docs])
    y = np.array([d[0] for d in kept or docs])

    def soft(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    # rows count one more miss in so many, so that a perfect sample doesn't drive the temperature to 0
    eps = 1 / (2 * len(y) + 2)
    best = min((0.05 * 1.25**k for k in range(28)), key=lambda t: -np.mean((1 - eps) * np.log(soft(t)[np.arange(len(y)), y] + 1e-12) + eps * np.log(soft(t) + 1e-12).mean(1)))
    p = soft(best)
    right = p.max(1)[p.argmax(1) == y]
    return Model(languages, table, bias, best, min(0.5, float(np.quantile(right, REJECT_SHARE))) if len(right) else 0.0)


def _sums(model: Model, buf: np.ndarray, offs: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each document the weighted sum of its n-grams' rows of the table, piece by piece."""
    z = np.zeros((len(offs) - 1, len(model.languages)), np.float64)
    for p, q in K.slices(offs, PIECE_BYTES):
        lo, hi = offs[p], offs[q]
        full = p + np.flatnonzero(np.diff(offs[p : q + 1]))
        if len(full):  # the last n-grams read on behind the piece
            one = sum(model.table[g[: hi - lo]] for g in ngrams(buf[lo : hi + max(ORDERS) - 1])) * w[lo:hi, None]
            z[full] = np.add.reduceat(one, offs[full] - lo, axis=0, dtype=np.float64)
    return z


def _predict(model: Model, kept: int, read: str = "_read"):
    """The first `kept` columns with the prediction for the text in the column `read`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for a, b, buf, offs in K.text_slices(batch, read):
                n = np.diff(offs)
                z = np.zeros((b - a, len(model.languages)), np.float64)
                score, won, total = np.zeros(b - a), np.full(b - a, len(model.languages)), np.zeros(b - a)
                letters = np.zeros(b - a, bool)
                if len(buf):
                    full = np.flatnonzero(n)
                    w = _weights(buf)
                    total[full] = np.add.reduceat(w, offs[full], dtype=np.float64)
                    letters[full] = np.add.reduceat(_LETTER[buf], offs[full], dtype=np.int64) > 0
                    for i in full[~letters[full]]:
                        letters[i] = any(ch.isalpha() for ch in buf[offs[i] : offs[i + 1]].tobytes().decode())
                    if model.languages:
                        z = _sums(model, buf, offs, w)
                if model.languages:
                    z = (z / np.maximum(1, total * len(ORDERS))[:, None] + model.bias) / model.temperature
                    p = np.exp(z - z.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    won, score = np.where(letters, p.argmax(1), won), np.where(letters, p.max(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in range(kept)], pa.array(names[won], pa.string()), pa.array(score), pa.array(~letters | (score < model.reject_below))],
                    [*batch.schema.names[:kept], "lang_pred", "score", "rejected"],
                )

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with lang_pred, score and rejected.

    A null text, or one without letters, is `und` with score 0 and rejected.  A
    kept column that has the name of a result gives way to it; other columns are
    ignored.  An empty table gives no rows; a text of any length is read whole.
    """
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score", "rejected", "_read")]
    rows, read = docs.select(*keep), text_col
    if keep.count(text_col) != 1 or dict(rows.dtypes).get(text_col) != "string":  # else the text is sent once
        rows, read = docs.select(*keep, F.col(text_col).cast("string").alias("_read")), "_read"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(_predict(model, len(keep), read), f"{kinds}, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs.

    The model learns from rows with a language whose crc32(id as text) modulo 5
    isn't 0; the others are held out.  Repeated rows and ids each give a row.
    An empty table gives no rows; without any labelled row all is `und`.
    """
    r = remainder(id_col)
    model = train(docs.filter(r != 0).select(F.col(id_col).cast("string").alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (r == 0).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model, ["doc_id", "held_out"])
