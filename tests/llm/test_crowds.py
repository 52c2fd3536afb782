"""Near duplicates among many documents that share a passage."""

import numpy as np

from emberline.llm import minhash_forest


def test_links_within_crowds(spark):
    rng = np.random.default_rng(5)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 50_000, k)]
    passage, texts = word(175), []
    for i in range(2000):
        own = word(25)
        texts.append(passage + own)
        if i % 4 == 0:  # a linked document besides: 3 of 200 words differ
            other = list(own)
            for k in range(0, 25, 9):
                other[k] = f"x{i}y{k}"
            texts.append(passage + other)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(docs, percent=85).collect()}

    sets = [{" ".join(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    common = {s for s in sets[0] if s in sets[1] and s in sets[2]}
    by_own: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        for g in s - common:
            by_own.setdefault(g, []).append(i)
    for a, b in {(m[0], x) for m in by_own.values() for x in m[1:]}:
        k = len(sets[a] & sets[b])
        if 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
            root[b] = root[a]
    assert len(set(root)) == 2000
    assert [got[i] for i in range(len(texts))] == root
