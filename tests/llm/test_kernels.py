"""Kernels without Spark: hashing, tokens, sorted orders, loser tree, clustering, k-means."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import class_lm, embedding_dedup, minhash_forest, soft_mixing, suffix_dedup
from emberline.llm import textkit as K


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_tokens_are_those_of_bytes_split(texts):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw], dtype=np.int64)]
    s, e, first = K.tokens(buf, offs)
    h = K.span_hash(K.prefix_hash(buf), s, e)
    for i, r in enumerate(raw):
        words = r.split()
        own = slice(first[i], first[i + 1])
        assert [buf[a:b].tobytes() for a, b in zip(s[own], e[own], strict=True)] == words
        assert [int(x) for x in h[own]] == [K.hash_bytes(w) for w in words]


def test_shingles():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(K.shingle_hashes(h, 5)) == 3 and len(K.shingle_hashes(h[:3], 5)) == 1 and len(K.shingle_hashes(h[:0], 5)) == 0
    assert K.shingle_hashes(h[:5], 5)[0] == K.shingle_hashes(h, 5)[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=7))
def test_loser_tree_merges_and_knows_common_prefixes(runs):
    coded = [[(n, rest, i) for n, rest in suffix_dedup.front_code(sorted(r))] for i, r in enumerate(runs)]
    out = list(suffix_dedup.LoserTree([iter(c) for c in coded]))
    assert [s for _, s, _ in out] == sorted(x for r in runs for x in r)
    prev = b""
    for n, s, _ in out:
        assert n == suffix_dedup.common(prev, s, 0)
        prev = s


def test_anchors_are_shared_by_equal_windows():
    rng = random.Random(3)
    common = bytes(rng.choice(b"abc ") for _ in range(260))
    docs = [bytes(rng.choice(b"abc ") for _ in range(150)) + common + bytes(rng.choice(b"abc ") for _ in range(80)) for _ in range(2)]
    buf, offs = np.frombuffer(b"".join(docs), np.uint8), np.array([0, len(docs[0]), len(docs[0]) * 2])
    d, place, lo, hi, gram, _ = suffix_dedup.anchors(buf, offs)
    seen = [{}, {}]
    for i in range(len(d)):
        for s in range(lo[i], hi[i] + 1):
            seen[d[i]][s] = (place[i] - s, gram[i])
    assert all(len(x) == len(docs[0]) - 199 for x in seen)
    assert all(seen[0][s] == seen[1][s] for s in range(150, 150 + 61))


def test_exchange_clustering_finds_two_alternating_classes():
    n = 21
    pairs = np.zeros((n, n), np.int64)
    a, b = np.arange(1, 11), np.arange(11, 21)
    pairs[np.ix_(a, b)] = 30
    pairs[np.ix_(b, a)] = 30
    pairs[0, a] = pairs[a, 0] = 2
    cls = class_lm.exchange_clustering(pairs, 3)
    assert cls[0] == 0 and len({*cls[a]}) == 1 and len({*cls[b]}) == 1 and cls[1] != cls[11]


def test_order_candidates_small_region_and_star():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, minhash_forest.DEPTH, dtype=np.uint8)
    keys = np.tile(base, (40, 1))
    for i in range(1, 40):
        keys[i, rng.integers(5, minhash_forest.DEPTH)] = rng.integers(0, 256)
    keys = np.concatenate([np.zeros((40, 1), np.uint8), keys], axis=1)
    keys = keys[np.lexsort(keys.T[::-1])]
    pairs = minhash_forest.order_candidates(keys)
    assert {*pairs.ravel().tolist()} == set(range(40)) and len(np.unique(pairs, axis=0)) < 40 * 39 / 2
    assert len(minhash_forest.order_candidates(keys[:1])) == 0


def test_spherical_kmeans_and_blocks():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embedding_dedup.spherical_kmeans(x, 5)
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
    ids = np.arange(400)
    links, edges = embedding_dedup.link_block(x, ids, x, ids, np.ones(400, np.int64), 0.8)
    want = (x @ x.T >= 0.8) & (ids[:, None] != ids)
    assert (links == want.sum(1)).all()
    par = list(range(400))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for a, b in edges:
        par[find(a)] = find(b)
    assert all(find(i) == find(j) for i, j in zip(*np.nonzero(want), strict=True)) and len(edges) < 400


def test_head_learns_a_word():
    rng = np.random.default_rng(4)
    docs = [np.unique(rng.integers(1, 50, 12).astype(np.uint64)) for _ in range(300)]
    y = np.array([float(7 in d) for d in docs])
    head = soft_mixing.fit_head(docs, y)
    assert head.weights[list(head.features).index(7)] > 2
    assert soft_mixing.fit_head([], np.zeros(0)).bias == 0


@pytest.mark.parametrize("weights,relative", [((0.0, 1.0, 1.0), True), ((0.0, 0.2, 0.8), False), ((0.3, 0.3, 0.4), False), ((1.0, 3.0, 0.5), True)])
def test_fitted_rates_are_the_least_squares(weights, relative):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.1, 0.2, 0.5], 400)
    n = rng.integers(0, 900, 400).astype(float)
    w = np.array(weights)
    want = lambda mass: w * mass if relative else w / w.sum() * mass.sum()
    pull = 0.01
    steps, mass, total = soft_mixing.fit_rates(lambda f: f(n[:150], p[:150]) + f(n[150:], p[150:]), want, pull)
    r = soft_mixing.replay(p, steps, pull)
    assert np.allclose(total, (n * r) @ p) and np.allclose(mass, n @ p) and len(steps) < 40
    # plain projected gradient, by documents, until it stands still
    scale, x = n.sum() / mass**2, np.ones(400)
    lipschitz = np.linalg.norm((p * n[:, None]).T @ p * scale, 2) + pull
    y, k = x, 1.0
    for _ in range(200_000):
        new = np.maximum(0, y - (p @ (scale * ((n * y) @ p - want(mass))) + pull * (y - 1)) / lipschitz)
        if np.abs(new - x).max() < 1e-13:
            break
        after = (1 + np.sqrt(1 + 4 * k * k)) / 2
        y, k = (new, 1.0) if (y - new) @ (new - x) > 0 else (new + (k - 1) / after * (new - x), after)
        x = new
    full = n > 0
    assert np.abs(r - x)[full].max() < 1e-4
    # and the conditions that only the least sum meets
    gradient = p @ (scale * (total - want(mass))) + pull * (r - 1)
    assert np.abs(gradient[full & (r > 0)]).max() < 1e-5 and (gradient[r == 0] > -1e-5).all()


def test_rates_without_tokens():
    assert soft_mixing.fit_rates(lambda f: f(np.zeros(3), np.full((3, 3), 1 / 3)), lambda m: m)[0] == []
