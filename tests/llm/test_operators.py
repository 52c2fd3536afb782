"""Operators against brute force on small tables with nulls, ties, repeats and odd texts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import chat_events, class_lm, embedding_dedup, hash_tree, language_id, minhash_forest, positional_index, soft_mixing, suffix_dedup, token_cache

LOW = {i: i + 32 for i in range(65, 91)}
WORDS = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "und", "le", "the"]


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(j) for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 40, n), strict=True))


BASE = text(1, 120)
EDIT = BASE.split()
EDIT[60] = "changed"
ROWS = [
    (1, BASE), (2, BASE), (3, " ".join(EDIT)), (4, text(2, 150)), (5, None), (6, ""), (7, " \t\n"), (8, "few words"), (9, "FEW  words"),
    (10, text(3, 30) + " " + BASE[100:700] + " " + text(4, 30)), (11, "é" * 900), (12, text(5, 20000)), (13, text(6, 13)), (4, text(2, 150)), (None, text(7, 40)), (14, "a" * 450), (15, " 　x"), (16, "<|endoftext|> ok it's"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({"class": F.lit(1), "key": F.lit("x"), "n": F.lit(0), "label": F.lit(3), "digest": F.lit("clash")})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("percent", [50, 65, 95])
def test_near_duplicates_at_other_thresholds(spark, percent):
    rng = np.random.default_rng(percent)
    texts = []
    for i in range(60):  # pairs whose similarity is a little above or below the threshold
        a = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        for off in (0.5, 2.0):
            same = int(296 * 2 * (percent + off * (-1) ** i) / (100 + percent + off * (-1) ** i))
            texts.append(" ".join(a))
            texts.append(" ".join(a[: same + 4] + [f"v{x}" for x in rng.integers(0, 10**6, 296 - same)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(df, percent=percent).collect()}
    sets = [shingles(t) for t in texts]
    for i in range(0, len(texts), 4):
        root = i
        for j in range(i + 1, i + 4):
            want = next((k for k in range(i, j) if 100 * len(sets[k] & sets[j]) >= percent * len(sets[k] | sets[j])), j)
            assert got[j] == (got[want] if want != j else j), (root, j)


def test_thresholds_the_trees_are_too_few_for():
    with pytest.raises(ValueError):
        minhash_forest.least_prefix(30)


def test_near_duplicates(docs, nothing):
    got = minhash_forest.near_duplicates(docs, percent=85).collect()
    assert len(got) == len(ROWS)
    link = lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b)
    sets = [shingles(t) for _, t in ROWS]
    par = list(range(len(ROWS)))

    def find(i):
        return i if par[i] == i else find(par[i])

    for i in range(len(ROWS)):
        for j in range(i):
            if link(sets[i], sets[j]):
                par[find(i)] = find(j)
    want = collections.Counter()
    for i, (k, _) in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if find(j) == find(i) and ROWS[j][0] is not None]
        c = min(ids, default=None) if sets[i] else k
        want[(k, len(sets[i]), c, c == k)] += 1
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert minhash_forest.near_duplicates(nothing).count() == 0


def brute_bytes(texts):
    where = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if where[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = len([m for m in re.finditer(b"\1+", bytes(gone))])
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_repeated_bytes(docs, nothing, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = suffix_dedup.repeated_bytes(docs).collect()
    want = brute_bytes([(t or "").encode() for _, t in ROWS])
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == collections.Counter((k, *w) for (k, _), w in zip(ROWS, want, strict=True))
    assert suffix_dedup.repeated_bytes(nothing).count() == 0


def test_class_scores(docs, nothing):
    got = class_lm.class_scores(docs).collect()
    toks = [(t or "").translate(LOW).encode().split() + [None] for _, t in ROWS]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1 for k, _ in ROWS]
    c = collections.Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(k), h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for (k, _), h, t in zip(ROWS, held, toks, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert class_lm.class_scores(nothing).count() == 0


def test_class_model_beats_unigrams_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = class_lm.class_scores(df).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_token_counts(docs, nothing, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = collections.Counter((k, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 50) for k, t in ROWS)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second run finds every count in the cache
        got = token_cache.token_counts(docs, path, cache, limit=50)
        assert collections.Counter(tuple(r) for r in got.collect()) == want
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({b" ".join((t or "").encode().split()) for _, t in ROWS})
    assert token_cache.token_counts(nothing, path).count() == 0


def test_other_tokenizers_are_refused(docs):
    import public_tokenizers

    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        with pytest.raises(ValueError):
            token_cache.token_counts(docs, public_tokenizers.path(name))


def test_token_counts_of_chunks_add_up():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = np.random.default_rng(8)
    pool = [" ", "\n", "\x0b", "\x1f", " ", " ", "a", "B", "é", "é", "́", "İ", "ß", "9", "'s", "!", "<|endoftext|>", "<|END", "中", "​", "🙂", "\t"]
    texts = ["".join(pool[i] for i in rng.integers(0, len(pool), 40)) for _ in range(400)]
    assert token_cache.count_tokens([t.encode() for t in texts], path) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_contamination(spark, docs, nothing):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    items = [(1, " ".join(BASE.split()[20:50])), (2, text(6, 13)), (3, "few words"), (4, None), (5, ""), (10, " ".join(BASE.split()[30:60])), (3, "few words")]
    win = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            win[tuple(w[i : i + n])].add(str(k))
    want = collections.Counter()
    for k, t in ROWS:
        w, hit, its = words(t), set(), set()
        for n in {len(x) for x in win}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in win:
                    hit |= set(range(i, i + n))
                    its |= win[tuple(w[i : i + n])]
        want[(k, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert collections.Counter(tuple(r) for r in positional_index.contamination(docs, bench).collect()) == want
    twice = positional_index.contamination(docs.unionByName(docs.filter("doc_id = 10")), bench)
    assert twice.exceptAll(positional_index.contamination(docs, bench)).count() == 1 and twice.filter("doc_id = 10").distinct().count() == 1
    assert positional_index.contamination(nothing, bench).count() == 0
    assert positional_index.contamination(docs, bench.filter("false")).filter("n_hit > 0").count() == 0


def test_index_with_terms_too_many_to_send(spark, docs, monkeypatch):
    item = " ".join(BASE.split()[20:50])
    bench = spark.createDataFrame([(1, item), (2, "few words"), (3, text(12, 60))], "item_id long, text string")
    want = sorted(map(str, positional_index.contamination(docs, bench).collect()))
    monkeypatch.setattr(positional_index, "SENT_ROWS", 0)
    monkeypatch.setattr(positional_index._sent, "__defaults__", (0,))
    monkeypatch.setattr(positional_index.build_index, "__defaults__", (0,))
    assert sorted(map(str, positional_index.contamination(docs, bench).collect())) == want


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, "b x x x a"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in positional_index.proximity_matches(df, "a", "b", 2).collect()) == [(1, 0, 1), (1, 3, 1)]


def test_languages(spark, docs, nothing):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.languages(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = got.count(), got.filter("lang = lang_pred").count()
    assert right >= 0.97 * n
    odd = {str(r.doc_id): r for r in language_id.languages(docs.withColumn("lang", F.lit("xx"))).collect()}
    assert odd["5"].lang_pred == odd["6"].lang_pred == odd["7"].lang_pred == "und" and odd["5"].score == 0 and odd["11"].lang_pred == "xx"
    assert language_id.languages(nothing.withColumn("lang", F.lit("xx"))).count() == 0
    assert {r.lang_pred for r in language_id.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_chat_events(spark):
    rows = [
        (1, 1, "message", 1, "user", "hi </s>[ROLE]&lt;"), (1, 2, "delta", 2, "assistant", "par"), (1, 3, "delta", 2, "assistant", "tial"), (1, 4, "regenerate", 2, "assistant", "new"), (1, 5, "delta", 2, "assistant", "er"),
        (1, 6, "edit", 1, "user", "edited & [x]"), (1, 7, "message", 3, None, None), (1, 8, "message", 4, "user", "gone"), (1, 9, "delete", 4, "user", None), (2, 1, "delete", 1, "user", "x"), (None, None, None, 1, "user", "null"),
    ]
    ev = spark.createDataFrame(rows, "conv_id long, seq long, kind string, target long, role string, text string")
    out = chat_events.render(chat_events.fold_events(ev))
    got = {r.conv_id: r for r in out.select("conv_id", chat_events.read_back(F.col("formatted")).alias("m"), chat_events.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("t"), "formatted").collect()}
    assert [(m.role, m.text) for m in got[1].m] == [("user", "edited & [x]"), ("assistant", "newer"), ("", "")] and got[1].t == ["newer"]
    assert got[2].m == [] and got[2].formatted == "" and [(m.role, m.text) for m in got[None].m] == [("user", "null")]
    assert chat_events.fold_events(ev.filter("false")).count() == 0


def test_shards(docs, nothing):
    got = hash_tree.shard_rows(docs).collect()
    assert len(got) == len(ROWS)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = collections.Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in ROWS)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert hash_tree.shard_rows(nothing).count() == 0


def test_repeated_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(hash_tree, "PIECE", 7)
    df = spark.range(200).selectExpr("CASE WHEN id < 100 THEN 5 ELSE id END AS doc_id", "CASE WHEN id < 90 THEN 'same' ELSE concat('t', id) END AS text")
    got = hash_tree.shard_rows(df).collect()
    assert len(got) == 200 and sum(r.doc_id == 5 for r in got) == 100
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    of_same = sorted(r.slot for r in got if r.doc_id == 5 and r.size == 5)
    assert len(of_same) == 90 and of_same == list(range(of_same[0], of_same[0] + 90))


def test_shards_are_even_and_move_little(spark):
    df = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = hash_tree.shard_rows(df).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("slots"), F.sum((F.col("grown_shard") == 8).cast("int")).alias("moved")).collect()
    assert len(got) == 8 and all(abs(r.n - 25_000) < 800 and r.top == r.n - 1 and r.slots == r.n for r in got)
    assert abs(sum(r.moved for r in got) - 200_000 / 9) < 1000


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(12, 6))
    rows = [(i, int(i % 2), [float(v) for v in centre[i % 12] + 0.25 * rng.normal(size=6)]) for i in range(240)]
    rows += [(300, 0, rows[0][2]), (301, 0, rows[0][2]), (302, None, rows[0][2]), (303, 0, None), (304, 0, [0.0] * 6), (305, 0, [float("nan")] * 6), (306, 0, [None] * 6), (307, 0, [1.0]), (308, 0, []), (309, 1, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("unit", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, 0.93).collect()}
    par = {r[0]: r[0] for r in rows}

    def find(i):
        return i if par[i] == i else find(par[i])

    n = collections.Counter()
    good = [(i, lab, np.array(v)) for i, lab, v in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for a in range(len(good)):
        for b in range(a):
            (i, p, x), (j, q, y) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                n[i] += 1
                n[j] += 1
                r, s = find(i), find(j)
                par[max(r, s)] = min(r, s)
    assert got == {k: (n[k], find(k), find(k) == k) for k in par} and sum(n.values()) > 100
    assert embedding_dedup.near_vectors(df.filter("false")).count() == 0


def known_toxic(out, labels):
    """Copies of documents that are labelled toxic and recognised as such."""
    return out.join(labels, "doc_id").filter("toxic = 1 and p_toxic > 0.5").agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n


def test_mixing(spark, docs, nothing):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = soft_mixing.fit_mixer(docs_, labels, {"toxic": 0.0, "low": 0.3, "high": 0.7})
    out = soft_mixing.mix(docs_, m, ["doc_id"])
    r = out.agg(F.sum("n_tokens").alias("all"), *[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in soft_mixing.DOMAINS]).first()
    assert r.low / r.all == pytest.approx(0.3, abs=0.01) and r.high / r.all == pytest.approx(0.7, abs=0.02)
    # nothing lies between the fit and its totals, and what misses the target is told
    got = [r.toxic, r.low, r.high]
    assert got == pytest.approx(list(m.total), rel=1e-9) and m.misfit == pytest.approx((np.array(got) - m.target) / m.mass, rel=1e-6)
    assert 0 < m.misfit[0] < 0.2 and np.abs(m.misfit[1:]).max() < 0.03
    assert known_toxic(out, labels) == 0
    known = out.join(labels, "doc_id")
    assert known.filter("toxic = 0 and p_toxic > 0.5").count() == 0 and known.filter("toxic = 1 and p_toxic > 0.5").count() >= 0.8 * known.filter("toxic = 1").count()
    none = soft_mixing.fit_mixer(docs, labels.filter("false"), {"toxic": 1.0, "low": 1.0, "high": 1.0}, relative=True)
    assert soft_mixing.mix(docs, none, ["doc_id", "key"]).filter("copies = 1").count() == len(ROWS)
    assert soft_mixing.mix(nothing, soft_mixing.fit_mixer(nothing, labels, {"toxic": 0.0, "low": 1.0, "high": 1.0}), ["doc_id"]).count() == 0

    # names that the operator uses itself, and an id that many documents share
    named = docs_.withColumns({c: F.lit(1) for c in ("quality", "toxic", "n_tokens", "rate", "_id", "_draw", "_read", "p_low")})
    again = soft_mixing.mix(named, soft_mixing.fit_mixer(named, labels, {"toxic": 0.0, "low": 0.3, "high": 0.7}), ["doc_id", "rate", "toxic"])
    assert again.columns == ["doc_id", "toxic", "n_tokens", "p_toxic", "p_low", "p_high", "rate", "copies"]
    assert again.select("doc_id", "copies").exceptAll(out.select("doc_id", "copies")).count() == 0
    one = docs_.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(6)).otherwise(F.col("doc_id")))
    assert soft_mixing.mix(one, soft_mixing.fit_mixer(one, labels, {"toxic": 0.0, "low": 0.3, "high": 0.7}), ["doc_id"]).count() == docs_.count()
