"""Near-duplicate documents with an LSH forest over MinHash signatures.

Every distinct set of word shingles gets a signature of ``SIGNATURE`` minimum
hashes.  The forest holds the signatures in several sorted orders (tree t reads
the signature from its own start on).  In each order candidates are the
neighbours with a long common prefix: the depth at which a region is compared
in full adapts to how crowded it is, and members of regions too crowded for
that are compared with their nearest neighbours in the order and with the
region's heaviest path, the signature that most of the region agrees with.
Candidates are confirmed on the full shingle sets.

Members of regions that weren't compared in full, and of regions cut by the end
of a stretch, are then compared by an exact join on the prefixes of their full
sets, rarest shingles first, wherever two are not in one group yet.

Copies of one set are one class from the start, so a group of exact copies,
however large, is one row of the forest.  The orders are range-partitioned,
so a crowded region spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import textkit as K
from emberline.llm.numbering import Numbers
from emberline.operators.components import connected_components
from emberline.operators.skew import join_unique
from emberline.plans.scratch import discard, materialize

SIGNATURE = 128
#: Trees of the forest, values in a tree's key (a byte each) and the least common prefix of a candidate pair at 0.8.
TREES, DEPTH, LEAST = 16, 64, 3
#: Chance with which a pair at the threshold may share too short a prefix in all trees; the prefix shortens until it is met.
MISS = 2e-5
#: A region of at most so many signatures is compared in full.
REGION = 6
#: Standard deviations below the threshold at which the share of equal signature values rules a candidate out; in crowds, where a pair isn't to be lost by chance, more.
SIEVE, CROWD_SIEVE = 5, 8
#: Best-connected members of a group that stand for it in the second round.
HUBS = 16
#: Bits of the table that tells common shingles from rare ones; it only orders them, so collisions cost time.
LEVEL_BITS = 20

_r = np.random.Generator(np.random.PCG64(7))
_A = _r.integers(0, 2**32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_B = _r.integers(0, 2**32, SIGNATURE, dtype=np.uint32)


def sieve(percent: int, deviations: float) -> float:
    """The share of equal signature values of a pair at the threshold, less so many standard deviations."""
    share = percent / 100
    return share - deviations * (share * (1 - share) / SIGNATURE) ** 0.5


def least_prefix(percent: int) -> int:
    """The longest common prefix, up to LEAST values, that a pair at the threshold has in some tree but for a chance of MISS."""
    share = percent / 100
    for k in range(LEAST, 0, -1):
        if (1 - share**k) ** TREES <= MISS:
            return k
    raise ValueError(f"{TREES} trees are too few for a similarity of {percent} percent")


def document_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, sorted, and their offsets."""
    buf = K.LOWER[buf]
    starts, ends, first = K.tokens(buf, offs)
    h = K.span_hash(K.prefix_hash(buf), starts, ends)
    sets = [np.unique(K.shingle_hashes(h[a:b], words)) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate(sets) if sets else h[:0], np.r_[0, np.cumsum([len(x) for x in sets], dtype=np.int64)]


def signatures(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Minimum hashes folded to 16 bits, one row for each set; zeros for an empty one."""
    full = np.flatnonzero(np.diff(offs))
    out = np.zeros((len(offs) - 1, SIGNATURE), dtype=np.uint16)
    if len(full):
        x = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
        for k in range(SIGNATURE):
            least = np.minimum.reduceat(x * _A[k] + _B[k], offs[full])
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)  # a minimum's own high bits are mostly 0
    return out


def _digest(flat: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits of each set, from sums that don't depend on the order."""
    n = np.diff(at)
    low, high = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(flat):
        full = np.flatnonzero(n)
        low[full], high[full] = np.add.reduceat(flat, at[full]), np.add.reduceat(K.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at[full])
    return [r.tobytes() for r in np.stack([K.mix(low + n.astype(np.uint64)), K.mix(high)], axis=1).astype(">u8")]


def _of_class(words: int):
    """Keep the rows whose text has the wanted digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in K.text_slices(batch, "text"):
                got = _digest(*document_sets(buf, offs, words))
                same = pa.array([x == y for x, y in zip(got, batch.column(1).slice(a, b - a).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a).filter(same) for c in (0, 2)], ["class", "text"])

    return run


def _sketch(words: int):
    """Per document: set size, a 128-bit digest of the set, its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, buf, offs in K.text_slices(batch, "text"):
                flat, at = document_sets(buf, offs, words)
                sig = signatures(flat, at)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(_digest(flat, at), pa.binary()), pa.array([r.tobytes() for r in sig.astype(">u2")], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "signature"],
                )

    return run


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the tree's number and the signature from the tree's start on."""
    step = SIGNATURE // TREES
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SIGNATURE * 2)[:, ::2]  # the high bytes
        for t in range(TREES):
            own = np.roll(sig, -step * t, axis=1)[:, :DEPTH]
            keys = np.concatenate([np.full((len(own), 1), t, np.uint8), own], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in keys], pa.binary())], ["class", "key"])


def order_candidates(keys: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Index pairs of candidates among sorted keys (tree byte, then DEPTH one-byte values).

    Pairs: the nearest neighbours in the order, everything within a region of at
    most REGION keys, and each member of a larger region with the end of the
    region's heaviest path, at every depth where the heaviest path leaves the member behind.
    """
    n = len(keys)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    differ = keys[1:, 1:] != keys[:-1, 1:]
    lcp = np.where(differ.any(1), differ.argmax(1), DEPTH)
    lcp[keys[1:, 0] != keys[:-1, 0]] = 0
    near = np.flatnonzero(lcp >= least)
    pairs = [np.stack([near, near + 1], axis=1)]
    cut = np.r_[0, np.flatnonzero(lcp < least) + 1, n]
    stack = [(int(a), int(b), least) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 2]
    while stack:
        a, b, depth = stack.pop()
        if b - a <= REGION:
            pairs.append(np.stack(np.triu_indices(b - a, 1), axis=1) + a)
            continue
        inner = lcp[a : b - 1]
        deeper = max(depth + 1, int(inner.min()) + 1)
        if deeper > DEPTH:  # all keys are the same to the end
            pairs.append(np.stack([np.full(b - a - 1, a), np.arange(a + 1, b)], axis=1))
            continue
        heavy_a, heavy_b, parts, d = a, b, None, deeper
        while d <= DEPTH and heavy_b - heavy_a > 1:
            at = np.r_[heavy_a, heavy_a + np.flatnonzero(lcp[heavy_a : heavy_b - 1] < d) + 1, heavy_b]
            parts = at if parts is None else parts
            k = int(np.diff(at).argmax())
            heavy_a, heavy_b = int(at[k]), int(at[k + 1])
            d = max(d + 1, int(lcp[heavy_a : heavy_b - 1].min()) + 1) if heavy_b - heavy_a > 1 else DEPTH + 1
        others = np.r_[a:heavy_a, heavy_a + 1 : b]
        pairs.append(np.stack([np.full(len(others), heavy_a), others], axis=1))
        stack += [(int(x), int(y), deeper) for x, y in zip(parts[:-1], parts[1:], strict=True) if y - x > 2]
    out = np.concatenate(pairs)
    return out[out[:, 0] != out[:, 1]]


def crowded(keys: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Indexes among sorted keys of regions above REGION, and of the first and last region, which may go on elsewhere."""
    n = len(keys)
    cut = np.r_[0, np.flatnonzero((keys[1:, : 1 + least] != keys[:-1, : 1 + least]).any(1)) + 1, n]
    size = np.diff(cut)
    large = size > REGION
    large[[0, -1]] = True
    return np.flatnonzero(np.repeat(large, size))


def _neighbours(least: int):
    """Candidate pairs of one stretch of the sorted orders, each once; a member of a crowd with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, keys = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            p = np.concatenate([order_candidates(keys, least), np.repeat(crowded(keys, least)[:, None], 2, axis=1)])
            p = np.unique(np.sort(ids[p], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 1 + DEPTH)))
                size += batch.num_rows
            if size >= 400_000:  # goes on with the last row, so that its neighbour isn't missed
                yield flush()
                held, size = [(held[-1][0][-1:], held[-1][1][-1:])], 1
        if held:
            yield flush()

    return run


def _agree(share: float):
    """Pairs of which enough signature values are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SIGNATURE) for c in (2, 3))
                keep = (x == y).mean(axis=1) >= share
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], ["a", "b"])

    return run


def _confirm(words: int, percent: int):
    """Pairs whose full shingle sets satisfy 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for ids, col in ((a, "text"), (b, "text_b")):
                buf, offs = K.column_bytes(batch.column(batch.schema.get_field_index(col)))
                for i, x in enumerate(ids):
                    if x not in known:
                        known[x] = document_sets(buf[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]), words)[0]
            ok = []
            for x, y in zip(a, b, strict=True):
                s, t = known[x], known[y]
                both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                ok.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _sieved(pairs: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    sig = classes.select("class", "signature")
    both = pairs.join(sig.select(F.col("class").alias("a"), F.col("signature").alias("x")), "a").join(sig.select(F.col("class").alias("b"), F.col("signature").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_agree(share), "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    full = pairs.join(texts.withColumnRenamed("class", "a"), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    return full.select("a", "b", "text", "text_b").mapInArrow(_confirm(words, percent), "a long, b long")


def _with_hubs(pairs: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """For candidates that stayed in two groups: each end with the hubs of the other's group.

    A large group may hang together by its best-connected members alone, which
    an order needn't bring beside all others.
    """
    ends_of = lambda df: df.select(F.col("a").alias("node")).unionAll(df.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n"))
    # the share of a member's candidates that were confirmed, against chance for few candidates
    degree = ends_of(links).join(ends_of(pairs).withColumnRenamed("n", "tried"), "node").select("node", (F.col("n") / (F.col("tried") + 4)).alias("n"))
    ranked = groups.join(degree, "node")
    # first within parts of a component, then among those that are left
    for key in (["component", F.pmod(F.xxhash64("node"), F.lit(64))], ["component"]):
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "node"))
        ranked = ranked.withColumn("rank", rank).filter(F.col("rank") <= HUBS)
    hubs = ranked.groupBy("component").agg(F.collect_list("node").alias("hubs")).filter("size(hubs) > 2")
    own = groups.join(hubs, "component", "left")
    at = lambda c: own.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"), F.col("hubs").alias(f"hubs_{c}"))
    apart = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").filter("not of_a <=> of_b")
    ends = apart.select(F.col("a").alias("x"), F.explode("hubs_b").alias("y")).unionAll(apart.select(F.col("b").alias("x"), F.explode("hubs_a").alias("y")))
    return ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")


def _bucket(flat: np.ndarray) -> np.ndarray:
    return (K.mix(flat) >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)


def _count_buckets(words: int):
    """Shingles in each bucket, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << LEVEL_BITS, np.int64)
        for batch in batches:
            for _, _, buf, offs in K.text_slices(batch, "text"):
                n += np.bincount(_bucket(document_sets(buf, offs, words)[0]), minlength=len(n))
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full])], ["bucket", "n"])

    return run


def prefixes(flat: np.ndarray, at: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, place, shingle) of the shingles of each set of which two linked sets share one at least, by level, then hash."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((flat, level[_bucket(flat)], owner))
    place = np.arange(len(flat)) - at[owner]
    head = place <= (n - -(-percent * n // 100))[owner]  # linked sets have percent of either in common
    return owner[head], place[head], flat[order][head]


def _prefix_rows(words: int, percent: int, level: np.ndarray):
    """A row for each shingle of a set's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in K.text_slices(batch, "text"):
                flat, at = document_sets(buf, offs, words)
                owner, place, h = prefixes(flat, at, level, percent)
                ids = batch.column(0).slice(a, b - a).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ids[owner]), pa.array(np.diff(at)[owner].astype(np.int32)), pa.array(place.astype(np.int32))], ["shingle", "class", "size", "place"]
                )

    return run


def _crowd_pairs(texts: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """All pairs of sets in two groups that can be linked, by an exact prefix join."""
    level = np.zeros(1 << LEVEL_BITS, np.uint8)
    got = texts.mapInArrow(_count_buckets(words), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    level[got.column("bucket").to_numpy()] = 4 * np.log2(got.column("n").to_numpy())
    posts = texts.mapInArrow(_prefix_rows(words, percent, level), "shingle long, class long, size int, place int")
    posts = posts.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    posts = materialize(posts, "minhash-prefixes")
    between = posts.groupBy("shingle").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p < q").select("shingle")
    met = materialize(posts.join(between, "shingle", "left_semi"), "minhash-prefixes")
    discard(posts)
    x, y = (met.select("shingle", *[F.col(c).alias(f"{c}_{end}") for c in ("class", "size", "place", "component")]) for end in "xy")
    # what two sets can have in common from their first common shingle on
    most = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")).cast("long")
    enough = (100 + percent) * most >= percent * (F.col("size_x").cast("long") + F.col("size_y"))
    both = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("class_x") < F.col("class_y")) & (F.col("component_x") != F.col("component_y")) & enough)
    return both.select(F.col("class_x").alias("a"), F.col("class_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their distinct shingles of `words` words (white-space words, A-Z lowered).
    component_id is the smallest id reachable by links.  The prefix that makes
    a candidate and the sieve follow `percent`; below about 50, where the trees
    are too few, it is a ValueError.

    A null or empty text and a text of white space have no shingles and are
    linked with nothing; fewer words than `words` are one shingle.  Rows that
    repeat an id are one document if their texts are equal, else each is linked
    for itself.  A null id takes part like any other and is never the smallest
    unless its component has no other.  Columns besides the two are ignored.
    """
    least, share = least_prefix(percent), sieve(percent, SIEVE)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = rows.mapInArrow(_sketch(words), "doc_id long, n_shingles long, digest binary, signature binary")
    sketch = materialize(sketch, "minhash-sketch")
    # a class is one distinct set; all its rows have the same signature
    one = sketch.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.first("signature").alias("signature"))
    one = materialize(one, "minhash-classes")
    numbers = Numbers(one)
    one = numbers.add(one)

    keys = one.select("class", "signature").mapInArrow(_grow, "class long, key binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = keys.repartitionByRange(parts, "key").sortWithinPartitions("key")
    found = materialize(ordered.mapInArrow(_neighbours(least), "a long, b long").distinct(), "minhash-found")
    crowd = found.filter("a = b").select(F.col("a").alias("class"))
    pairs = materialize(_sieved(found.filter("a <> b"), one, share), "minhash-pairs")

    ends = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).unionAll(crowd).distinct()
    wanted = ends.join(one.select("class", "least_id", "digest"), "class")
    # rows that repeat an id may have other texts, which the digest tells apart
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["least_id"])).select("class", "digest", "text")
    texts = texts.mapInArrow(_of_class(words), "class long, text string").groupBy("class").agg(F.first("text").alias("text"))
    texts = materialize(texts, "minhash-texts")
    links = materialize(_linked(pairs, texts, words, percent), "minhash-links")
    groups = materialize(connected_components(links, "a", "b"), "minhash-groups")
    more = _sieved(_with_hubs(pairs, links, groups), one, share)
    more = materialize(_linked(more, texts, words, percent), "minhash-links")
    joined = lambda links: connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(links), "a", "b")
    if not more.isEmpty():
        groups = materialize(joined(more), "minhash-groups")
    rest = _sieved(_crowd_pairs(texts.join(crowd, "class", "left_semi"), groups, words, percent), one, sieve(percent, CROWD_SIEVE))
    rest = materialize(_linked(rest, texts, words, percent), "minhash-links")
    discard(texts)
    if not rest.isEmpty():
        groups = joined(rest)

    member = one.join(groups.withColumnRenamed("node", "class"), "class", "left").select("class", "least_id", F.coalesce("component", "class").alias("root"))
    smallest = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = materialize(member.join(smallest, "root").select("class", "component_id"), "minhash-components")
    # a set that very many rows have is sent to them
    out = join_unique(numbers.add(sketch).select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class")).alias("class")), of_class, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
