"""Each stage of the pipeline against a plain version on a small table with nulls, repeats, ties and clashing columns."""

import re

import corpus_pipeline
import pytest
from emberline.llm import soft_mixing

DATA = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, _row long, rate int"


def _words(text, rx):
    return re.findall(rx, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _shingles(text):
    w = _words(text, r"[^\x20\x09-\x0D]+")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _plain_near_copies(rows):
    """One of each group of rows linked at 0.8: that of the least id, a null id last."""
    rows = list(dict.fromkeys(rows))
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return groups.values()


def _plain_hit(text, items):
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = _words(text, rx)
    for item in items:
        own = _words(item, rx)
        n = min(13, len(own))
        wanted = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        if any(tuple(w[i : i + n]) in wanted for i in range(len(w) - n + 1)):
            return True
    return False


@pytest.fixture(scope="module")
def table(spark):
    """Documents, and besides nulls, empty and long texts, repeats, shared ids and passages of the benchmark in long texts."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    item = next(t for t in items if len((t or "").split()) > 20)
    prose = " ".join(t for _, t, lang, *_ in docs if t and lang == docs[0][2])
    long = prose[:60_000]
    more = [
        (9001, None), (9001, None), (None, None), (9002, ""), (None, "?! 12"), (None, docs[0][1]), (docs[0][0], docs[0][1]), (docs[0][0], docs[1][1]),
        (9003, long), (9004, long[:30_000] + " " + item + " " + long[30_000:]), (9005, long[:40_000] + " " + " ".join(item.split()[:14])), (9005, docs[2][1]), (None, "so " + item),
    ]
    rows = docs + [(i, t, docs[0][2], None, len(t or "")) for i, t in more]
    return spark.createDataFrame([(*r, 1.0, 1, 1) for r in rows], KINDS), items


def _got(df):
    assert df.columns == corpus_pipeline.COLUMNS
    return [(r.doc_id, r.text) for r in df.collect()]


def _sorted(rows):
    return sorted(rows, key=lambda r: (str(r[0]), str(r[1])))


def test_language(spark, table):
    before = [(r.doc_id, r.text) for r in table[0].collect()]
    kept = _got(corpus_pipeline.language(spark, table[0], DATA))
    left = list(before)
    for r in kept:
        left.remove(r)  # every row kept is one of those before, as often as there
    assert all(any(c.isalpha() for c in t or "") for _, t in kept)
    # what goes besides texts without letters is rare, and rows of equal text share one fate
    gone = [t for _, t in left if any(c.isalpha() for c in t or "")]
    assert len(gone) <= 0.05 * len(before) and not {t for _, t in kept} & set(gone)


def test_near_copies(spark, table):
    rows = [(r.doc_id, r.text) for r in table[0].collect()]
    got = _got(corpus_pipeline.near_copies(spark, table[0], DATA))
    groups = list(_plain_near_copies(rows))
    assert len(got) == len(set(got)) == len(groups)
    for g in groups:
        kept = [r for r in g if r in got]
        least = min((i is None, i or 0) for i, _ in g)
        assert len(kept) == 1 and (kept[0][0] is None, kept[0][0] or 0) == least


def test_decontaminate(spark, table):
    docs, items = table
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [r for r in rows if not _plain_hit(r[1], items)]
    assert _sorted(_got(corpus_pipeline.decontaminate(spark, docs, DATA))) == _sorted(want)
    ids = [i for i, _ in want]
    assert 9003 in ids and 9004 not in ids and ids.count(9005) == 1 and len(want) < len(rows) - 3


def test_mixture(spark, table):
    docs, _ = table
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = _got(corpus_pipeline.mixture(spark, docs, DATA))
    rated = soft_mixing.mix(docs, soft_mixing.fit_mixer(docs, labels, corpus_pipeline.WEIGHTS, relative=True, pull=corpus_pipeline.PULL), ["doc_id", "text"]).collect()
    assert _sorted(got) == _sorted([(r.doc_id, r.text) for r in rated for _ in range(r.copies)])
    assert all(abs(r.copies - r.rate) < 1 for r in rated)
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    clean = [r for r in rated if r.p_toxic < 0.02]
    assert sum(r.copies > 0 for r in clean) >= 0.99 * len(clean)
    assert not [r for r in rated if r.doc_id in toxic and r.p_toxic > 0.5 and r.copies]


def test_shard(spark, table):
    out = corpus_pipeline.shard(spark, table[0], DATA).collect()
    assert len(out) == table[0].count()
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
    assert all(len(x) == 1 and all(g in (s, 8) for s, g in x) for x in by.values())
