"""Mixing to target weights with soft domain membership.

A classifier fitted on a table of labels gives every document a posterior over
domains.  Nonnegative document rates r are then fitted so that the expected
tokens of each domain, sum of rate * tokens * posterior, match the targets:

    min over r >= 0 of  sum_d ((A r - T)_d / M_d)^2 + pull * sum_i n_i (r_i - 1)^2 / sum_i n_i

where M are the domains' tokens at rate 1.  It is solved by projected gradient
steps, scaled by the normal equations of the documents that aren't held at 0
(a step of the whole length solves the problem if none of them crosses 0, a
shorter one is taken where that wouldn't lower the sum).  A step needs a few
sums over the documents: a rate follows from the posterior and the steps so
far, so every task replays them (a handful) and no rates are stored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkit as K
from emberline.plans.scratch import discard, materialize

#: Labelled rows that the classifier is fitted on, at most about (a hash decides which).
SAMPLE = 6000
#: Features that each of the two heads selects.
FEATURES = 128
#: Weight of the pull towards rate 1 against the misfit of the totals: more keeps rates nearer to 1, less the totals nearer to the targets.
PULL = 0.01
#: The fit ends when a whole step moves the mean rate by less than this; more steps than MOST_STEPS raise an error.
CLOSE, MOST_STEPS = 1e-9, 200
#: Lengths that are tried for a step.
LENGTHS = tuple(0.5**k for k in range(8))
DOMAINS = ("toxic", "low", "high")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_NOT_WORD, _NOT_MARK = ~_LETTER, _LETTER | K.SPACE
_NOT_MARK[0x30:0x3A] = True


@dataclass
class Head:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class Step:
    gradient: np.ndarray  # of the misfit by a domain's tokens: which documents at rate 0 stay there
    towards: np.ndarray  # a free document moves towards 1 - posterior @ towards
    length: float


@dataclass
class Mixer:
    """The classifier's heads, the steps, and for DOMAINS the tokens at rate 1, the targets and the totals of the fitted rates."""

    toxic: Head
    quality: Head
    steps: list[Step]
    mass: np.ndarray
    target: np.ndarray
    total: np.ndarray
    pull: float = PULL

    @property
    def misfit(self) -> np.ndarray:
        """(total - target) / mass of each domain; other than 0 where nonnegative rates can't meet the target or the pull holds."""
        return np.divide(self.total - self.target, self.mass, out=np.zeros(len(DOMAINS)), where=self.mass > 0)


def _terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the runs of punctuation, and the document of each."""
    buf = K.LOWER[buf]
    prefix = K.prefix_hash(buf)
    parts = []
    for delim in (_NOT_WORD, _NOT_MARK):
        s, e, first = K.tokens(buf, offs, delim)
        parts.append((K.span_hash(prefix, s, e), np.repeat(np.arange(len(offs) - 1), np.diff(first))))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, b, buf, offs in K.text_slices(batch, "text"):
            h, doc = _terms(buf, offs)
            out += [(a + i, np.unique(h[doc == i]).tobytes()) for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for _, x in out], pa.binary())], ["quality", "toxic", "terms"])


def fit_head(docs: list[np.ndarray], y: np.ndarray) -> Head:
    """Logistic regression on the terms that tell the two sides apart best (likelihood ratio), with a ridge."""
    n, pos = len(y), float(y.sum())
    none = np.zeros(0, np.uint64)
    if not n or pos in (0, n):
        p = (pos + 0.5) / (n + 1)
        return Head(none, np.zeros(0), float(np.log(p / (1 - p))))
    terms, at = np.unique(np.concatenate(docs), return_inverse=True)
    row = np.repeat(np.arange(n), [len(d) for d in docs])
    have = np.bincount(at, minlength=len(terms)).astype(float)
    with_pos = np.bincount(at, weights=y[row], minlength=len(terms))
    xlogx = lambda v: v * np.log(np.maximum(v, 1e-12))
    cells = [with_pos, have - with_pos, pos - with_pos, n - pos - have + with_pos]
    ratio = sum(xlogx(c) for c in cells) - xlogx(have) - xlogx(n - have)
    chosen = np.sort(np.argsort(-ratio, kind="stable")[:FEATURES])
    x = np.zeros((n, len(chosen) + 1))
    x[:, -1] = 1
    place = np.searchsorted(chosen, at)
    inside = (place < len(chosen)) & (chosen[np.minimum(place, len(chosen) - 1)] == at)
    x[row[inside], place[inside]] = 1
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(len(chosen), 0.5), 1e-6]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    order = np.argsort(terms[chosen])
    return Head(terms[chosen][order], w[:-1][order], float(w[-1]))


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Head, Head]:
    """The heads for toxic and quality, from a sample of at most about SAMPLE ids of labels. Rows with a null are left out."""
    known = labels.select(F.col(id_col).alias("_id"), "quality", "toxic").filter("_id is not null and quality is not null and toxic is not null")
    n = known.count()
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(draw < min(1.0, SAMPLE / max(1, n))).groupBy("_id").agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    # an id that many documents share is one row, its least text
    rows = texts.join(F.broadcast(sample), "_id").groupBy("_id", "quality", "toxic").agg(F.min("text").alias("text")).select("quality", "toxic", "text")
    # the sample is bounded: one task fits, and only the heads reach the driver
    for r in rows.mapInArrow(_features, "quality int, toxic int, terms binary").repartition(1).mapInArrow(_fit_task, "heads binary").collect():
        return pickle.loads(r.heads)
    return fit_head([], np.zeros(0)), fit_head([], np.zeros(0))


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((terms, q, t) for batch in batches for q, t, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    sets = [np.frombuffer(r[0], np.uint64) for r in rows]
    heads = tuple(fit_head(sets, np.array([float(r[i] > 0) for r in rows])) for i in (2, 1))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(heads)], pa.binary())], ["heads"])


def _posteriors(buf: np.ndarray, offs: np.ndarray, toxic: Head, quality: Head) -> tuple[np.ndarray, np.ndarray]:
    """(white-space words, posterior over DOMAINS) of each document."""
    n = len(offs) - 1
    _, _, first = K.tokens(buf, offs)
    h, doc = _terms(buf, offs)
    p = []
    for head in (toxic, quality):
        z = np.full(n, head.bias)
        if len(head.features) and len(h):
            at = np.minimum(np.searchsorted(head.features, h), len(head.features) - 1)
            hit = head.features[at] == h
            seen = np.zeros((n, len(head.features)), bool)
            seen[doc[hit], at[hit]] = True
            z += seen @ head.weights
        p.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    t, q = p
    return np.diff(first), np.stack([t, (1 - t) * (1 - q), (1 - t) * q], axis=1)


def moved(post: np.ndarray, r: np.ndarray, step: Step, pull: float, length: float | None = None) -> np.ndarray:
    """The rates after a step: documents at 0 whose gradient keeps them there stay, the others move and are cut at 0."""
    free = _free(post, r, step.gradient, pull)
    t = step.length if length is None else length
    return np.where(free, np.maximum(0.0, r + t * (1 - post @ step.towards - r)), 0.0)


def _free(post: np.ndarray, r: np.ndarray, gradient: np.ndarray, pull: float) -> np.ndarray:
    return (r > 0) | (post @ gradient + pull * (r - 1) < 0)


def replay(post: np.ndarray, steps: list[Step], pull: float) -> np.ndarray:
    """The rates after all steps."""
    r = np.ones(len(post))
    for step in steps:
        r = moved(post, r, step, pull)
    return r


def _weigh(toxic: Head, quality: Head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in K.text_slices(batch, "text"):
                n, p = _posteriors(buf, offs, toxic, quality)
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), *[pa.array(p[:, k]) for k in range(3)]], ["n", *DOMAINS])

    return run


def _totals(table: DataFrame, sums) -> np.ndarray:  # noqa: ANN001
    """The sum over the table's batches of sums(tokens, posteriors), a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            p = np.stack([batch.column(1 + k).to_numpy() for k in range(3)], axis=1)
            got = sums(batch.column(0).to_numpy().astype(float), p)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

    got = table.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r.k] = r.v
    return out


def fit_rates(totals, target, pull: float = PULL) -> tuple[list[Step], np.ndarray, np.ndarray]:  # noqa: ANN001
    """(steps, mass, totals) of the fit.

    totals(f) is the sum of f(tokens, posteriors) over all documents, which may
    stand anywhere; target maps the mass of the domains to their targets.
    """
    d = len(DOMAINS)
    mass = totals(lambda n, p: n @ p)
    if not mass.sum():
        return [], np.zeros(d), np.zeros(d)
    size, want = mass.sum(), target(mass)
    weight = np.divide(size, mass**2, out=np.zeros(d), where=mass > 0)
    cost = lambda total, apart: weight @ (total - want) ** 2 / 2 + pull * apart / 2
    steps: list[Step] = []
    now, best = mass, cost(mass, 0.0)
    for _ in range(MOST_STEPS):
        gradient = weight * (now - want)

        def normal(n: np.ndarray, p: np.ndarray, gradient: np.ndarray = gradient, steps: tuple = tuple(steps)) -> np.ndarray:
            free = _free(p, replay(p, steps, pull), gradient, pull)
            mass_of = p[free] * n[free, None]
            return np.concatenate([(mass_of.T @ p[free]).ravel(), mass_of.sum(0)])

        got = totals(normal)
        g, a = got[: d * d].reshape(d, d), got[d * d :]
        # where the free documents would go, if none of them crossed 0
        towards = weight / pull * np.linalg.solve(np.eye(d) + g * weight / pull, a - want)
        step = Step(gradient, towards, 1.0)

        def tried(n: np.ndarray, p: np.ndarray, step: Step = step, steps: tuple = tuple(steps)) -> np.ndarray:
            r = replay(p, steps, pull)
            out = []
            for t in LENGTHS:
                x = moved(p, r, step, pull, t)
                out += [*((n * x) @ p), n @ (x - 1) ** 2, n @ np.abs(x - r)]
            return np.array(out)

        got = totals(tried).reshape(len(LENGTHS), d + 2)
        costs = [cost(x[:d], x[d]) for x in got]
        k = next((k for k, c in enumerate(costs) if c <= best), None)
        if k is None or got[k, -1] / size < CLOSE:
            if got[0, -1] / size < 1e3 * CLOSE:  # as near as doubles come
                return steps, mass, now
            if k is None:
                raise RuntimeError("no length of a step lowers the misfit")
        steps.append(Step(gradient, towards, LENGTHS[k]))
        now, best = got[k, :d], costs[k]
    raise RuntimeError(f"the rates haven't settled after {MOST_STEPS} steps")


def fit_mixer(docs: DataFrame, labels: DataFrame, weights: dict[str, float], relative: bool = False, id_col: str = "doc_id", text_col: str = "text", pull: float = PULL) -> Mixer:
    """Fit classifier and rates.

    weights: for each of DOMAINS its share of the tokens, or with relative=True
    the factor by which its expected tokens change.  No documents, or none with
    tokens, give no steps.  Labels whose rows hold a null are left out; labels
    of one id count as one, by its highest marks; without any label all
    posteriors are a half.  Other columns of both tables are ignored.
    """
    toxic, quality = fit_classifier(docs, labels, id_col, text_col)
    table = materialize(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_weigh(toxic, quality), "n int, toxic double, low double, high double"), "mix-posteriors")
    w = np.array([weights[d] for d in DOMAINS], float)
    want = lambda mass: w * mass if relative else w / w.sum() * mass.sum()

    def totals(sums) -> np.ndarray:  # noqa: ANN001
        got = _totals(table, sums)
        return got if len(got) else np.zeros(len(DOMAINS))

    steps, mass, total = fit_rates(totals, want, pull)
    discard(table)
    return Mixer(toxic, quality, steps, mass, want(mass), total, pull)


def _rates(m: Mixer, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in K.text_slices(batch, "_read"):
                n, p = _posteriors(buf, offs, m.toxic, m.quality)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in range(columns)], pa.array(n), *[pa.array(p[:, k]) for k in range(3)], pa.array(replay(p, m.steps, m.pull))], [*batch.schema.names[:columns], "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate"]
                )

    return run


def mix(docs: DataFrame, mixer: Mixer, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with n_tokens, p_toxic, p_low, p_high, rate and copies.

    copies realises the rate: its whole part, and one more with the chance of
    the rest, decided by a hash of id and text, so that the expected copies are
    the rate.  A null or empty text has no tokens and the posterior of a text
    without any known term.  Repeated rows and ids each give a row, a text of
    any length is read whole.  A kept column that has the name of a result gives
    way to it; other columns are ignored.  An empty table gives no rows.
    """
    names = ["n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies"]
    keep = [c for c in keep if c.lower() not in names]
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(*keep, draw.alias("_draw"), F.col(text_col).cast("string").alias("_read"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    extra = "n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + ", rate double"
    out = rows.mapInArrow(_rates(mixer, len(keep) + 1), f"{kinds}, {extra}")
    return out.withColumn("copies", F.floor(F.col("rate") + F.col("_draw")).cast("int")).drop("_draw")
