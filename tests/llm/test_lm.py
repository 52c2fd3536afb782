"""The class-based model against a plain version: classes of the words that aren't units, class bigrams, scores, and that probabilities add up to one."""

import collections
import math

import numpy as np
import pytest

from emberline.llm import class_lm as L

LOW = {i: i + 32 for i in range(65, 91)}


def codes(words):
    """(hash, ending) of each word."""
    raw = [w.encode() for w in words]
    h, u, at = L._tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return {w: (int(h[i]), int(u[i])) for w, i in zip(words, at[:-1], strict=True)}


@pytest.mark.parametrize("listed", [1 << 17, 2100])
def test_scores_against_a_plain_version(spark, listed, monkeypatch):
    monkeypatch.setattr(L, "LISTED", listed)
    got_model = []
    fit = L._fit
    monkeypatch.setattr(L, "_fit", lambda t, v: got_model.append(fit(t, v)) or got_model[0])
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in L.class_scores(df).collect()}
    m, classes = got_model[0]
    moved = {r.word: r.cls for r in classes.collect()}

    texts = {r.doc_id: (r.text or "").translate(LOW).encode() for r in df.select("doc_id", "text").collect()}
    docs = {k: [w.decode() for w in t.split()] for k, t in texts.items()}
    of = codes(sorted({w for ws in docs.values() for w in ws}))
    train = [docs[k] for k, r in got.items() if not r.held_out]
    n = collections.Counter(w for ws in train for w in ws)
    top = sorted([*((-c, of[w][0], w) for w, c in n.items()), (-len(train), L.END, None)])[:listed]
    listed_words = {w for _, _, w in top}
    units = {w: i + 1 for i, (_, _, w) in enumerate([x for x in top if x[2] is not None][: L.UNITS])}
    unit = lambda w: units.get(w, of[w][1])
    core = lambda w: int(m.cls[unit(w)])

    joint = np.zeros((L.CLASSES, L.CLASSES))
    near = collections.defaultdict(lambda: np.zeros((2, L.CLASSES)))
    for ws in train:
        ks = [0, *map(core, ws), 0]
        for a, b in zip(ks, ks[1:], strict=False):
            joint[a, b] += 1
        for i, w in enumerate(ws):
            if w not in units and n[w] >= L.LEAST:
                near[w][0, ks[i]] += 1
                near[w][1, ks[i + 2]] += 1
    assert len(moved) == len(near) > 500 and {of[w][0] for w in near} == set(moved)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for w, (left, right) in near.items():
        sign = np.where(np.arange(L.CLASSES) == core(w), -1, 1)
        gain = sum((sign * (f(np.maximum(0, c + x[:, None] * sign)) - f(c))).sum(0) for c, x in ((joint, left), (joint.T, right)))
        gain -= sum(sign * (f(np.maximum(0, c + sign * n[w])) - f(c)) for c in (joint.sum(0), joint.sum(1)))
        assert gain[moved[of[w][0]]] >= gain[1:].max() - 1e-6
    says = lambda w: moved.get(of[w][0], core(w)) if w in near else core(w)
    stands = lambda w: says(w) if w in listed_words else core(w)
    joint = np.zeros((L.CLASSES, L.CLASSES))
    for ws in train:
        for a, b in zip([0, *map(stands, ws)], [*map(says, ws), 0], strict=True):
            joint[a, b] += 1
    size = joint.sum(0)
    endings = np.bincount(m.cls[1 + L.UNITS :], minlength=L.CLASSES)
    mass, once = collections.Counter(), collections.Counter()
    for w, c in n.items():
        if w not in units and c < L.LEAST:
            mass[of[w][1]] += c
            once[of[w][1]] += c == 1
    unseen = lambda u: min(0.9, max(1e-6, (once[u] + 0.1) / (mass[u] + 1)))
    share = (size + 0.5) / (size + 0.5).sum()
    step = (joint + share) / (joint.sum(1) + 1)[:, None]

    def word(w, before):
        k, u = says(w), of[w][1]
        if w in units or w in near:
            return step[before, k] * n[w] / (size[k] + 0.1 * endings[k])
        own = (1 - unseen(u)) * n[w] / max(1, mass[u]) if n[w] else unseen(u)
        return step[before, k] * (mass[u] + 0.1) / (size[k] + 0.1 * endings[k]) * own

    assert len(got) == len(docs)
    for k, ws in docs.items():
        at, total = 0, 0.0
        for w in ws:
            total += math.log10(word(w, at))
            at = stands(w)
        assert got[k].score == pytest.approx(total + math.log10(step[at, 0]), rel=1e-9, abs=1e-6)

    gone = lambda u: unseen(u) if mass[u] else 1.0  # an ending without seen words has unseen ones only
    for before in (0, 1, 7):
        whole = step[before, 0] + sum(word(w, before) for w in n)
        whole += sum(step[before, m.cls[u]] * (mass[u] + 0.1) / (size[m.cls[u]] + 0.1 * endings[m.cls[u]]) * gone(u) for u in range(1 + L.UNITS, L._ALL))
        assert whole == pytest.approx(1.0, abs=1e-4)
