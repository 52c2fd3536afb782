"""Language-model scoring with a Brown class-based bigram model.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)).  Classes come from exchange
clustering over corpus-wide bigram counts, in two parts.  The most frequent words
and, for all other words, their endings are units that move one at a time to the
class that raises the likelihood most, until a round moves few.  Then every other
word seen ``LEAST`` times or more, however many there are, leaves its ending for
the class that raises the likelihood most, all at once in a distributed round
over their counts of the classes before and after.  Only rarer words stay with
their ending and share its emissions; an unseen word has the ending's share of
unseen words, estimated from the words seen once.

All counts are over the whole training part.  The tables sent to every task
have fixed sizes (``LISTED`` words, the units, the classes); classes and counts
of the other words, of which there is no bound, are looked up by a join.  As the
word before, such a word stands for its ending's class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkit as K
from emberline.plans.scratch import materialize

#: Words whose counts every task holds; words that are units; units for endings; classes.
LISTED, UNITS, ENDINGS, CLASSES = 1 << 17, 2048, 256, 64
#: Occurrences from which on a word has a class of its own, not that of its ending.
LEAST = 5
ROUNDS = 6
#: Tokens that a task counts before it passes the counts on.
FLUSH = 1 << 21
#: The token after the last word; no word has its bytes.
END = K.hash_bytes(b" end of text ") - 2**63
_ALL = 1 + UNITS + ENDINGS


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending unit, offsets by document) of all tokens, an end after the words of each document."""
    buf = K.LOWER[buf]
    s, e, first = K.tokens(buf, offs)
    h = K.span_hash(K.prefix_hash(buf), s, e)
    # the last two bytes that aren't punctuation, or the last two
    mark = (buf < 0x30) | ((buf > 0x39) & (buf < 0x61)) | ((buf > 0x7A) & (buf < 0x80))
    cut = e.copy()
    for _ in range(2):
        back = (cut - s > 2) & mark[np.maximum(cut - 1, 0)]
        cut -= back
    last, prev = buf[cut - 1].astype(np.uint32), np.where(cut - s > 1, buf[np.maximum(cut - 2, 0)], 0).astype(np.uint32)
    ending = ((prev * np.uint32(256) + last) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    n = len(offs) - 1
    at = first + np.arange(n + 1)
    hashes, units = np.full(len(h) + n, END, np.int64), np.zeros(len(h) + n, np.int32)
    own = np.ones(len(h) + n, bool)
    own[at[1:] - 1] = False
    hashes[own], units[own] = (h ^ np.uint64(1 << 63)).view(np.int64), ending.astype(np.int32) + 1 + UNITS
    return hashes, units, at


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (word, ending, n)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        h = np.concatenate([x for x, _ in held])
        u = np.concatenate([x for _, x in held])
        words, at, n = np.unique(h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(u[at]), pa.array(n.astype(np.int64))], ["word", "ending", "n"])

    for batch in batches:
        for _, _, buf, offs in K.text_slices(batch, "text"):
            h, u, _ = _tokens(buf, offs)
            held.append((h, u))
            size += len(h)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


@dataclass
class Units:
    """The frequent words: sorted hashes, their counts, their unit (0: none) and the class of those that left their ending (-1: none)."""

    words: np.ndarray
    counts: np.ndarray
    unit: np.ndarray
    cls: np.ndarray

    def of(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(unit, count, listed, class or -1) of tokens; the end is unit 0."""
        if not len(self.words):
            none = np.full(len(h), -1)
            return np.where(h == END, 0, ending), np.zeros(len(h), np.int64), none >= 0, none
        i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        listed = self.words[i] == h
        unit = np.where(listed & (self.unit[i] > 0), self.unit[i], ending)
        return np.where(h == END, 0, unit), np.where(listed, self.counts[i], 0), listed, np.where(listed, self.cls[i], -1)


def _count_pairs(units: Units):
    """Partial counts of unit bigrams, the end standing before the first word too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for _, _, buf, offs in K.text_slices(batch, "text"):
                h, ending, _ = _tokens(buf, offs)
                u, _, _, _ = units.of(h, ending)
                before = np.r_[0, u[:-1]]  # an end is always the last of its document
                held.append(before * _ALL + u)
                size += len(u)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def exchange_clustering(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit, from the matrix of bigram counts; unit 0 (the end) is class 0 alone.

    Maximises sum f(N(c, d)) - sum f(N(c, .)) - sum f(N(., d)) with f(x) = x log x
    by moving one unit at a time.
    """
    n = len(pairs)
    b = pairs.astype(np.float64)
    right, left = b.sum(1), b.sum(0)
    by_size = np.argsort(-(right + left), kind="stable")
    by_size = by_size[by_size != 0]
    cls = np.zeros(n, np.int64)
    cls[by_size] = 1 + np.arange(len(by_size)) % (classes - 1)
    own = np.zeros((n, classes))
    own[np.arange(n), cls] = 1
    to, fro = b @ own, b.T @ own  # unit to class, and class to unit, by unit
    joint = own.T @ to
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(rounds):
        moved = 0
        for u in by_size:
            if right[u] + left[u] == 0:
                continue
            a = cls[u]
            r, le, self_ = to[u].copy(), fro[u].copy(), b[u, u]
            # take the unit out of its class
            r[a] -= self_
            le[a] -= self_
            joint[a] -= r
            joint[:, a] -= le
            joint[a, a] -= self_
            rows, cols = joint.sum(1) + le, joint.sum(0) + r  # wherever the unit goes, its neighbours keep these
            now = f(joint)
            add = f(joint + r[None, :]) - now
            gain = add.sum(1) - np.diag(add)
            add = f(joint + le[:, None]) - now
            gain += add.sum(0) - np.diag(add)
            d = np.diag(joint)
            gain += f(d + r + le + self_) - f(d)
            gain -= f(rows + right[u]) - f(rows) + f(cols + left[u]) - f(cols)
            gain[0] = -np.inf
            c = int(gain.argmax())
            if gain[c] <= gain[a] + 1e-9:
                c = a
            joint[c] += r
            joint[:, c] += le
            joint[c, c] += self_
            if c != a:
                moved += 1
                cls[u] = c
                to[:, a] -= b[:, u]
                to[:, c] += b[:, u]
                fro[:, a] -= b[u]
                fro[:, c] += b[u]
        if moved <= 0.002 * n:
            break
    return cls


def _count_neighbours(units: Units, cls: np.ndarray, rest: bool):
    """Partial counts (word, code, n) of the classes next to the words that aren't units.

    code is the class before, or CLASSES and the class after.  Listed words below
    LEAST are left out, and with rest = False all that aren't listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            key, n = np.unique(at * (2 * CLASSES) + np.concatenate([x for _, x in held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words[key // (2 * CLASSES)]), pa.array((key % (2 * CLASSES)).astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "code", "n"])

        for batch in batches:
            for _, _, buf, offs in K.text_slices(batch, "text"):
                h, ending, _ = _tokens(buf, offs)
                u, n, listed, _ = units.of(h, ending)
                k = cls[u]
                at = np.flatnonzero((u > UNITS) & np.where(listed, n >= LEAST, rest))  # never an end, so a token follows
                if not len(at):
                    continue
                before = np.where(at > 0, k[np.maximum(at, 1) - 1], 0)
                held.append((np.r_[h[at], h[at]], np.r_[before, CLASSES + k[at + 1]]))
                size += 2 * len(at)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _move(joint: np.ndarray, cls: np.ndarray):
    """(word, n, cls): the class of each word that raises the likelihood most, against the counts before the round."""
    near = np.vstack([joint, joint.T]).astype(np.float64)
    ahead, behind = joint.sum(0).astype(np.float64), joint.sum(1).astype(np.float64)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))

    def change(x: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What adding n to each cell gains; in the word's present class, where n is already in, what n holds there."""
        out = f(x + n[:, None]) - f(x)
        i = np.arange(len(n))
        out[i, at] = f(x[i, at]) - f(np.maximum(0.0, x[i, at] - n))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 1000):
                batch = whole.slice(a, 1000)
                lists = batch.column("near")
                first = np.diff(lists.offsets.to_numpy(), prepend=0)[1:]
                flat = lists.flatten()
                code, n = flat.field("code").to_numpy(), flat.field("n").to_numpy().astype(np.float64)
                of = np.repeat(np.arange(len(batch)), first)
                own = cls[batch.column("ending").to_numpy()]
                seen = batch.column("n").to_numpy().astype(np.float64)
                gain = np.zeros((len(batch), CLASSES))
                begins = np.r_[0, np.cumsum(first)[:-1]]
                gain += np.add.reduceat(change(near[code], n, own[of]), begins, axis=0)
                for side in (ahead, behind):
                    gain -= change(np.tile(side, (len(batch), 1)), seen, own)
                gain[:, 0] = -np.inf
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(gain.argmax(1).astype(np.int32))], ["word", "cls"])

    return run


def _count_steps(units: Units, cls: np.ndarray):
    """Partial counts (word, step, n) of class bigrams; word is null but for words that aren't listed, which have their ending's class here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in K.text_slices(batch, "text"):
                h, ending, _ = _tokens(buf, offs)
                u, _, listed, own = units.of(h, ending)
                k = np.where(own >= 0, own, cls[u])
                step = np.r_[0, k[:-1]] * CLASSES + k
                open_ = ~listed & (u > 0)
                key, n = np.unique(step[~open_], return_counts=True)
                words, at = np.unique(h[open_], return_inverse=True)
                more, m = np.unique(at * CLASSES**2 + step[open_], return_counts=True)
                word = pa.concat_arrays([pa.nulls(len(key), pa.int64()), pa.array(words[more // CLASSES**2], pa.int64())])
                yield pa.RecordBatch.from_arrays([word, pa.array(np.r_[key, more % CLASSES**2].astype(np.int32)), pa.array(np.r_[n, m].astype(np.int64))], ["word", "step", "n"])

    return run


@dataclass
class Model:
    units: Units
    cls: np.ndarray  # unit to class
    step: np.ndarray  # log10 P(class | class before)
    scale: np.ndarray  # log10 of the tokens of each class, with those added for its endings
    emit: np.ndarray  # log10 P(ending | class), by unit
    mass: np.ndarray  # tokens of the words that stay with each ending
    unseen: np.ndarray  # share of unseen words in an ending's tokens
    total: int
    types: int


def _score(m: Model):
    """Per row: tokens, known ones, both scores without the words that aren't listed, and those words by the class before them."""
    base_unit = 0.5 * (m.types + 1) + m.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in K.text_slices(batch, "text"):
                h, ending, at = _tokens(buf, offs)
                u, c, listed, own = m.units.of(h, ending)
                k = np.where(own >= 0, own, m.cls[u])
                prev = np.r_[0, k[:-1]]
                s = m.step[prev, k]
                alone = listed & (u > 0) & ((u <= UNITS) | (own >= 0))
                s[alone] += np.log10(c[alone]) - m.scale[k[alone]]
                inside = listed & (u > 0) & ~alone
                s[inside] += m.emit[u[inside]] + np.log10((1 - m.unseen[u[inside]]) * c[inside] / m.mass[u[inside]])
                base = np.where(listed, np.log10((c + 0.5) / base_unit), 0.0)
                n = np.diff(at)
                open_ = np.flatnonzero(~listed & (u > 0))
                s[open_] = 0.0
                base[(u == 0) & ~listed] = np.log10(0.5 / base_unit)
                doc = np.repeat(np.arange(b - a), n)[open_]
                order = np.lexsort((prev[open_], h[open_], doc))
                doc, word, unit, left = doc[order], h[open_][order], u[open_][order], prev[open_][order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]) | (left[1:] != left[:-1])]) if len(doc) else doc
                times = np.diff(np.r_[first, len(doc)])
                offsets = np.searchsorted(doc[first], np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(word[first]), *(pa.array(x.astype(np.int32)) for x in (unit[first], left[first], times))], ["word", "unit", "prev", "times"]),
                )
                sums = lambda x: np.add.reduceat(x, at[:-1]) if b > a else x
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(sums((c > 0).astype(np.int64))), pa.array(sums(base)), pa.array(sums(s)), lists],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "open"],
                )

    return run


def _fit(train: DataFrame, vocabulary: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and (word, cls) of all words that left their ending."""
    total, types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = vocabulary.orderBy(F.desc("n"), "word").limit(LISTED).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, counts, ends = (top.column(c).to_numpy() for c in ("word", "n", "ending"))
    rank = np.arange(len(words)) - (np.cumsum(words == END) > 0) + 1  # the end isn't a word
    unit = np.where((rank <= UNITS) & (words != END), rank, 0)
    order = np.argsort(words)
    units = Units(words[order], counts[order], unit[order], np.full(len(words), -1))

    pairs = np.zeros(_ALL * _ALL, np.int64)
    table = train.mapInArrow(_count_pairs(units), "pair int, n long").groupBy("pair").agg(F.sum("n").cast("long").alias("n"))
    got = materialize(table, "lm-pairs").toArrow()
    pairs[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    pairs = pairs.reshape(_ALL, _ALL)
    cls = exchange_clustering(pairs, CLASSES)
    own = np.zeros((_ALL, CLASSES))
    own[np.arange(_ALL), cls] = 1

    # no word outside the list is as frequent as LEAST if one in it isn't
    rest = bool(types > len(words) and counts.min() >= LEAST)
    near = train.mapInArrow(_count_neighbours(units, cls, rest), "word long, code int, n long").groupBy("word", "code").agg(F.sum("n").cast("long").alias("n"))
    near = near.groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("near"))  # at most 2 * CLASSES
    near = near.join(vocabulary.filter(F.col("n") >= LEAST), "word").select("word", "n", "ending", "near")
    classes = materialize(near.mapInArrow(_move(own.T @ pairs @ own, cls), "word long, cls int"), "lm-classes")

    if len(words):
        # joined by value: the listed words are a table of fixed size
        mine = classes.join(F.broadcast(train.sparkSession.createDataFrame(pa.table({"word": units.words}))), "word").toArrow()
        units.cls[np.searchsorted(units.words, mine.column("word").to_numpy())] = mine.column("cls").to_numpy()
    counted = train.mapInArrow(_count_steps(units, cls), "word long, step int, n long").groupBy("word", "step").agg(F.sum("n").cast("long").alias("n"))
    if rest:
        left = F.col("step") - F.pmod("step", F.lit(CLASSES))
        counted = counted.join(classes, "word", "left").select(F.when(F.col("cls").isNull(), F.col("step")).otherwise(left + F.col("cls")).alias("step"), "n")
    joint = np.zeros(CLASSES * CLASSES)
    for r in materialize(counted.groupBy("step").agg(F.sum("n").cast("long").alias("n")), "lm-steps").collect():
        joint[r.step] = r.n
    joint = joint.reshape(CLASSES, CLASSES)

    mass, once = np.zeros(_ALL), np.zeros(_ALL)
    for r in vocabulary.filter(F.col("n") < LEAST).groupBy("ending").agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("int")).alias("k")).collect():
        mass[r.ending], once[r.ending] = r.n, r.k
    few = (unit > 0) & (counts < LEAST)
    np.subtract.at(mass, ends[few], counts[few])
    np.subtract.at(once, ends[few], counts[few] == 1)
    unseen = np.clip((once + 0.1) / (mass + 1.0), 1e-6, 0.9)
    size = joint.sum(0)
    share = (size + 0.5) / (size + 0.5).sum()
    step = np.log10((joint + 1.0 * share[None, :]) / (joint.sum(1) + 1.0)[:, None])
    scale = np.log10(np.maximum(size + 0.1 * np.bincount(cls[1 + UNITS :], minlength=CLASSES), 1e-300))
    emit = np.log10(mass + 0.1) - scale[cls]
    return Model(units, cls, step, scale, emit, np.maximum(1.0, mass), unseen, int(total), int(types)), classes


def class_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Rows whose crc32(id as text) modulo 5 is 1 are held out; the model and the
    base counts are of the others.  A null or empty text is one token, the end.
    base_score is the smoothed unigram log10 probability, score the model's; in
    both, unseen words are one symbol (here: one for each ending), over which and
    the seen words the probabilities after any word add up to one.  A text of any
    length is read whole, in one task; other columns of docs are ignored.
    Repeated rows count and are scored each; a null id is the empty string's.
    Without training rows every token is unseen.
    """
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    train = rows.filter("not held_out").select("text")
    vocabulary = train.mapInArrow(_count_words, "word long, ending int, n long").groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").cast("long").alias("n"))
    vocabulary = materialize(vocabulary, "lm-words")
    m, classes = _fit(train, vocabulary)

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, open array<struct<word: bigint, unit: int, prev: int, times: int>>"
    scored = materialize(rows.mapInArrow(_score(m), kinds).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    opened = scored.select("row", F.explode("open").alias("o")).select("row", "o.word", "o.unit", "o.prev", "o.times")
    spark = docs.sparkSession
    endings = spark.createDataFrame([(int(u), int(m.cls[u]), float(m.emit[u]), float(m.mass[u]), float(m.unseen[u])) for u in range(1 + UNITS, _ALL)], "unit int, home int, emit double, mass double, unseen double")
    steps = spark.createDataFrame([(c, k, float(m.step[c, k]), float(m.scale[k])) for c in range(CLASSES) for k in range(CLASSES)], "prev int, cls int, step double, scale double")
    rare = vocabulary.select("word", "n").join(classes, "word", "left")
    found = opened.join(rare, "word", "left").join(F.broadcast(endings), "unit").withColumn("left", F.col("cls").isNull()).withColumn("cls", F.coalesce("cls", "home")).join(F.broadcast(steps), ["prev", "cls"])
    n = F.coalesce("n", F.lit(0))
    whole = float(m.total + 0.5 * (m.types + 1))
    with_ending = F.col("emit") + F.when(n > 0, F.log10((1 - F.col("unseen")) * n / F.col("mass"))).otherwise(F.log10("unseen"))
    own = F.col("step") + F.when(F.col("left"), with_ending).otherwise(F.log10(n) - F.col("scale"))
    extra = found.groupBy("row").agg(F.sum(F.col("times") * own).alias("own"), F.sum(F.col("times") * F.log10((n + 0.5) / whole)).alias("base_more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known_more"))
    out = scored.drop("open").join(extra, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("known_more")).cast("long").alias("n_known"),
        F.lit(m.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_more")).alias("base_score"),
        (F.col("model") + zero("own")).alias("score"),
    )
