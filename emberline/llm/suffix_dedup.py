"""Exact substring deduplication by sorting suffixes.

Bytes covered by a string of ``WIDTH`` bytes that also starts anywhere else are
removed.  Each window of WIDTH bytes has an anchor, the smallest hash among its
``GRAM``-byte strings, and equal windows have equal anchors in equal places.
So only suffixes that start at anchors are considered, and of those only the
ones whose first GRAM bytes start elsewhere too (the duplicate detection of
prefix-doubling string sorting).  An anchor whose whole surroundings repeat is
decided by that (by 128-bit digests of the surroundings); the others, near the ends of repeated passages, are sorted:
every task sorts its suffixes into runs, front-codes them (length of the prefix
shared with the one before, then the rest), and sends each run to the task that
has its suffixes' first GRAM bytes; there a loser tree merges the runs and never compares a prefix
again that it knows to be common.  The common prefixes that the merge yields,
with what precedes the anchors, tell which windows repeat.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkit as K
from emberline.operators.skew import join_unique
from emberline.plans.scratch import materialize

WIDTH, GRAM = 200, 64
#: GRAM-byte strings in a window; the farthest an anchor can be from its window's start.
SPAN = WIDTH - GRAM + 1
#: Suffixes with one first GRAM bytes that one task merges; larger groups are decided window by window.
GROUP = 20_000
#: Bytes of one document handled at once; windows of the next part overlap it.
PART = 1 << 22


# --- anchors -----------------------------------------------------------------


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    n = len(x) - w + 1
    pad = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    before = np.minimum.accumulate(pad, axis=1).ravel()
    after = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def _digest(raw: bytes, place: int = 0) -> bytes:
    """128 bits that stand for the bytes and a place in them; no two of 10^12 strings are expected to share them."""
    return hashlib.blake2b(raw, digest_size=16, salt=place.to_bytes(4, "little")).digest()


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(document, place, first, last, gram hash, digest of the surroundings) of every anchor of the documents in buf.

    The windows that start at first..last have the anchor; all are places in the document.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < WIDTH:
        return none, none, none, none, none.astype(np.uint64), []
    prefix = K.prefix_hash(buf)
    at = np.arange(len(buf) - GRAM + 1)
    gram = K.span_hash(prefix, at, at + GRAM)
    key = (gram & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)  # ties: the first in the window
    least = (_sliding_min(key, SPAN) & np.uint64(0xFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(least)]
    ok = np.arange(len(least)) + WIDTH <= offs[doc + 1]
    start = np.flatnonzero(ok)
    a = least[start]
    new = np.r_[True, (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)] if len(start) else np.zeros(0, bool)
    i = np.flatnonzero(new)
    first, last, place = start[i], start[np.r_[i[1:], len(start)] - 1] if len(i) else start[i], a[i]
    raw = buf.tobytes()
    around = [_digest(raw[x:y], p) for x, y, p in zip(first.tolist(), (last + WIDTH).tolist(), (place - first).tolist(), strict=True)]
    d = doc[first] if len(i) else none
    base = offs[:-1][d]
    return d, place - base, first - base, last - base, gram[place], around


def _parts(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, offset in it, bytes, offsets): slices of documents, long documents in overlapping parts."""
    for a, b in K.slices(offs):
        if b == a + 1 and offs[b] - offs[a] > PART:
            for s in range(0, int(offs[b] - offs[a]) - WIDTH + 1, PART):
                own = buf[offs[a] + s : min(offs[b], offs[a] + s + PART + WIDTH - 1)]
                yield a, s, own, np.array([0, len(own)])
        else:
            yield a, 0, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def _class_of(raw: bytes) -> bytes:
    """What stands for equal texts."""
    return _digest(raw)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offs in K.text_slices(batch, "text"):
            raw = buf.tobytes()
            each = [raw[s:e] for s, e in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([_class_of(x) for x in each], pa.binary()), pa.array(np.diff(offs)), pa.array([hashlib.sha256(x).hexdigest() for x in each])],
                ["doc_id", "class", "n_bytes", "whole_sha256"],
            )


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of the texts; of texts that stand in a batch more than once, only the first's."""
    for batch in batches:
        buf, offs = K.column_bytes(batch.column(0))
        classes = [_class_of(buf[offs[i] : offs[i + 1]].tobytes()) for i in range(batch.num_rows)]
        first = np.zeros(len(classes), bool)
        first[list({c: i for i, c in reversed(list(enumerate(classes)))}.values())] = True
        classes = pa.array(classes, pa.binary())
        for a, s, own, at in _parts(buf, offs):
            d, place, lo, hi, gram, around = anchors(own, at)
            keep = first[a + d]
            spots = [pa.array((x[keep] + s).astype(np.int32)) for x in (place, lo, hi)]
            near = pa.array(around, pa.binary()).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([classes.take(pa.array(a + d[keep])), *spots, pa.array(gram[keep].view(np.int64)), near], ["class", "place", "lo", "hi", "gram", "around"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for _, _, buf, offs in K.text_slices(batch, "text"):
            raw, found = buf.tobytes(), {}
            for s, e in zip(offs[:-1], offs[1:], strict=True):
                if e - s >= WIDTH:
                    found.setdefault(_class_of(raw[s:e]), raw[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([pack.compress(x) for x in found.values()], pa.binary())], ["class", "packed"])


# --- sorted runs ---------------------------------------------------------------


def front_code(strings: list[bytes]) -> list[tuple[int, bytes]]:
    """Sorted strings as (length of the prefix shared with the one before, rest)."""
    out, prev = [], b""
    for s in strings:
        n = common(prev, s, 0)
        out.append((n, s[n:]))
        prev = s
    return out


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to be common."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo = known
    step = 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(n, lo + step)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class LoserTree:
    """Merges sorted front-coded runs; yields (common prefix with the string before, string, payload).

    Each entrant carries the length of the prefix it shares with the last winner
    that passed its place.  Of two entrants the one that shares more is smaller;
    only if both share the same, bytes after that prefix are compared, and the
    loser then knows what it shares with the winner.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.k = 1
        while self.k < max(1, len(runs)):
            self.k *= 2
        self.runs = [*runs, *[iter(())] * (self.k - len(runs))]
        self.now: list[tuple[bytes, object] | None] = [None] * self.k
        self.lcp = [0] * self.k
        self.tree = [-1] * self.k

    def _advance(self, r: int) -> None:
        item = next(self.runs[r], None)
        if item is None:
            self.now[r] = None
        else:
            n, rest, payload = item
            before = self.now[r][0] if self.now[r] else b""
            self.now[r], self.lcp[r] = (before[:n] + rest, payload), n

    def _play(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser), and set what the loser shares with the winner."""
        a, b = self.now[x], self.now[y]
        if a is None or b is None:
            return (x, y) if b is None else (y, x)
        p, q = self.lcp[x], self.lcp[y]
        if p != q:
            return (x, y) if p > q else (y, x)
        n = common(a[0], b[0], p)
        if a[0][n : n + 1] <= b[0][n : n + 1]:
            self.lcp[y] = n
            return x, y
        self.lcp[x] = n
        return y, x

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        for r in range(self.k):
            self._advance(r)
        win = [*[0] * self.k, *range(self.k)]
        for node in range(self.k - 1, 0, -1):
            win[node], self.tree[node] = self._play(win[2 * node], win[2 * node + 1])
        w = win[1] if self.k > 1 else 0
        while self.now[w] is not None:
            s, payload = self.now[w]
            yield self.lcp[w], s, payload
            self._advance(w)
            node = (self.k + w) // 2
            while node >= 1:
                w, self.tree[node] = self._play(w, self.tree[node])
                node //= 2


#: Class, gram, place, lo, hi, shared prefix, length of the rest, length of what precedes the anchor.
_HEAD = "<16sqiiiHHH"
_HEAD_BYTES = struct.calcsize(_HEAD)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, tuple[bytes, int, int, int, int]]]:
    """(suffix from the anchor, what precedes it, (class, gram, place, lo, hi)) of the asked anchors of packed texts."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for cls, packed, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if asked:
                raw = unpack.decompress(packed)
                for x in asked:
                    yield raw[x["place"] : x["hi"] + WIDTH], raw[x["lo"] : x["place"]], (cls, x["gram"], x["place"], x["lo"], x["hi"])


def _runs(parts: int):
    """Sorted front-coded runs, one for each key range."""

    def cut(held: list) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for x in held:
            by.setdefault(x[2][1] % parts, []).append(x)
        for part, own in by.items():
            own.sort(key=lambda x: x[0])
            body, prev = [], b""
            for s, left, (cls, gram, place, lo, hi) in own:
                n = common(prev, s, 0)
                body.append(struct.pack(_HEAD, cls, gram, place, lo, hi, n, len(s) - n, len(left)) + s[n:] + left)
                prev = s
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(body))], pa.binary())], ["part", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for x in _suffixes(batches):
            held.append(x)
            if len(held) >= 200_000:
                yield from cut(held)
                held = []
        if held:
            yield from cut(held)

    return run


def _decode(run: bytes) -> Iterator[tuple[int, bytes, object]]:
    raw = zstandard.ZstdDecompressor().decompress(run)
    i = 0
    while i < len(raw):
        cls, gram, place, lo, hi, n, rest, left = struct.unpack_from(_HEAD, raw, i)
        i += _HEAD_BYTES
        yield n, raw[i : i + rest], (raw[i + rest : i + rest + left], cls, gram, place, lo, hi)
        i += rest + left


def repeated_windows(lcp: np.ndarray, right: np.ndarray, left: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which windows of sorted suffixes repeat: a matrix, suffix by distance o of the anchor from the window's start.

    lcp[i] is what suffix i shares with i-1; right is the suffix's length; the
    bytes before the anchor stand at the end of the SPAN-1 columns of left; the
    suffix has windows at distances after..before.
    """
    n = len(lcp)
    out = np.zeros((n, SPAN), bool)
    ends = np.zeros(n, np.uint64)  # hash of the last o bytes before the anchor
    for o in range(SPAN):
        if o:
            ends = K.mix(ends * np.uint64(0x100000001B3) + left[:, SPAN - 1 - o].astype(np.uint64) + np.uint64(1))
        has = (before >= o) & (after <= o) & (right >= WIDTH - o)
        same = np.cumsum(lcp < WIDTH - o)
        at = np.flatnonzero(has)
        if len(at) > 1:
            key = K.mix(same[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ends[at])
            _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
            out[at[cnt[inv] > 1], o] = True
    return out


def _merge(table: pa.Table) -> pa.Table:
    """Ranges of the repeated windows of one key range."""
    runs = [_decode(x) for x in table.column("run").to_pylist()]
    cls_out, s_out, e_out = [], [], []
    codes: dict[bytes, int] = {}

    def close(held: list) -> None:
        if len(held) < 2:
            return
        lcp = np.array([x[0] for x in held])
        lcp[0] = 0
        right = np.array([x[1] for x in held])
        info = np.array([(codes.setdefault(x[3], len(codes)), *x[4:]) for x in held], np.int64)  # class, place, lo, hi
        left = np.zeros((len(held), SPAN - 1), np.uint8)
        for i, x in enumerate(held):
            if x[2]:
                left[i, SPAN - 1 - len(x[2]) :] = np.frombuffer(x[2], np.uint8)
        hit = repeated_windows(lcp, right, left, info[:, 1] - info[:, 2], info[:, 1] - info[:, 3])
        row, o = np.nonzero(hit)
        cls_out.append(info[row, 0])
        s_out.append(info[row, 1] - o)
        e_out.append(info[row, 1] - o + WIDTH)

    held: list = []
    size = 0
    for n, s, (left, cls, _, place, lo, hi) in LoserTree(runs):
        if n < GRAM and held and size >= 20_000:  # another gram: what is held can be decided
            close(held)
            held, size = [], 0
        held.append((n, len(s), left, cls, place, lo, hi))
        size += 1
    close(held)
    cls = np.concatenate(cls_out) if cls_out else np.zeros(0, np.int64)
    s, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (s_out, e_out))
    # windows that overlap become one range
    order = np.lexsort((s, cls))
    cls, s, e = cls[order], s[order], e[order]
    if len(cls):
        new = np.r_[True, (cls[1:] != cls[:-1]) | (s[1:] > e[:-1])]
        i = np.flatnonzero(new)
        cls, s, e = cls[i], s[i], np.maximum.reduceat(e, i)
    return pa.table({"class": pa.array(list(codes), pa.binary()).take(pa.array(cls)), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32))})


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes for each window of the asked anchors, for groups too large for one merge."""
    for s, left, (cls, _, place, lo, hi) in _suffixes(batches):
        buf = np.frombuffer(left + s, np.uint8)
        at = np.arange(hi - lo + 1)
        halves = [K.mix(K.span_hash(K.prefix_hash(buf, other), at, at + WIDTH) + (place - lo - at).astype(np.uint64)) for other in (False, True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(h.view(np.int64)) for h in halves], pa.array([cls] * len(at), pa.binary()), pa.array((lo + at).astype(np.int32))], ["window", "window_b", "class", "s"])


# --- removal -------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: removed bytes, spans and the digest of the rest."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple[int, int, int, str]] = []
        for cls, packed, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = unpack.decompress(packed)
            kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
            for s, e in sorted((r["s"], r["e"]) for r in ranges):
                if e <= at and at:
                    continue
                if s > at or not spans:
                    kept.update(raw[at:s])
                    spans += 1
                    removed += e - s
                else:
                    removed += e - at
                at = e
            kept.update(raw[at:])
            out.append((cls, removed, spans, kept.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out]) for i in range(4)], ["class", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    A byte is removed if a string of 200 bytes that covers it also starts
    anywhere else, in the same or another row; strings never cross rows.  A null
    text is empty.  Of rows with equal texts of 200 bytes or more nothing is
    left.  Texts and surroundings are taken as equal if their 128-bit digests are.
    Repeated ids each give a row.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = materialize(rows.mapInArrow(_summaries, "doc_id long, class binary, n_bytes long, whole_sha256 string"), "suffix-summaries")
    copies = base.groupBy("class").agg(F.count("*").alias("copies"), F.max("n_bytes").alias("size")).filter(f"size >= {WIDTH}")

    found = rows.select("text").mapInArrow(_anchors_of, "class binary, place int, lo int, hi int, gram long, around binary")
    spot = F.xxhash64("class", "place")
    # written first, so that the join with it can split the rows of a very common gram
    grams = materialize(found.groupBy("gram").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).filter("a <> b").select("gram"), "suffix-grams")
    several = materialize(found.join(grams, "gram").distinct(), "suffix-anchors")
    spread = several.groupBy("around").agg(F.count("*").alias("times"), F.min(F.struct("class", "place")).alias("lead"))
    # whole: all windows of the anchor repeat; of equal surroundings one stands for all among the suffixes to be sorted
    whole = F.col("times") > 1
    # surroundings that very many anchors share are sent to them
    anchor = join_unique(several, spread, "around").select("class", "gram", "place", "lo", "hi", whole.alias("whole"), (~whole | (F.col("lead") == F.struct("class", "place"))).alias("entry"))
    anchor = materialize(anchor, "suffix-anchors")
    groups = anchor.groupBy("gram").agg(F.sum(F.col("entry").cast("int")).alias("entries"), F.max(~F.col("whole")).alias("open"))
    asked = anchor.filter("entry").join(groups.filter("open"), "gram")
    item = F.struct("gram", "place", "lo", "hi")
    small = F.col("entries") <= GROUP
    lists = asked.groupBy("class").agg(F.collect_list(F.when(small, item)).alias("asked"), F.collect_list(F.when(~small, item)).alias("large"))
    need = anchor.select("class").distinct().join(lists, "class", "left")
    texts = rows.select("text").mapInArrow(_packed, "class binary, packed binary").groupBy("class").agg(F.first("packed").alias("packed"))
    texts = materialize(texts.join(need, "class").select("class", "packed", "asked", "large"), "suffix-texts")

    total = texts.agg(F.sum(F.size("asked"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 50_000)
    runs = texts.filter("size(asked) > 0").select("class", "packed", "asked").mapInArrow(_runs(parts), "part int, run binary")
    merged = runs.groupBy("part").applyInArrow(_merge, "class binary, s int, e int")
    hashed = texts.filter("size(large) > 0").select("class", "packed", "large").mapInArrow(_windows_of, "window long, window_b long, class binary, s int")
    twice = hashed.groupBy("window", "window_b").agg(F.count("*").alias("n")).filter("n > 1")
    single = hashed.join(twice, ["window", "window_b"]).select("class", "s", (F.col("s") + WIDTH).alias("e"))
    decided = anchor.filter("whole").select("class", F.col("lo").alias("s"), (F.col("hi") + WIDTH).alias("e"))
    ranges = decided.unionAll(merged).unionAll(single).groupBy("class").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    cut = texts.select("class", "packed").join(ranges, "class").select("class", "packed", "ranges")
    cut = materialize(cut.mapInArrow(_cut, "class binary, n_removed long, n_spans long, kept_sha256 string"), "suffix-cut")

    repeated = copies.filter("copies > 1").select("class", F.lit(True).alias("gone"))
    out = base.join(repeated, "class", "left").join(cut, "class", "left")
    gone = F.coalesce("gone", F.lit(False))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
