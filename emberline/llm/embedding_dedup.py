"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors that are equal are one class from the start.  Spherical k-means, fitted
on a bounded sample, gives each vector a home cell.  Two vectors that are close
may have different homes; a vector at most as far from the border of another
cell as a link can reach is compared there too, so no link is lost.  Within a
cell, blocks of home vectors meet blocks of all vectors in one matrix product
each; a block returns sums of links and a spanning forest, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.numbering import Numbers
from emberline.operators.components import connected_components
from emberline.operators.skew import join_unique
from emberline.plans.scratch import materialize

#: Vectors that k-means is fitted on, at most about (a hash decides which).
SAMPLE = 20_000
#: Vectors of one label and cell that are aimed at, and rows of a block.
CELL, BLOCK = 4096, 4096
#: Cells at most, whatever the size: the table of centroids is sent to all tasks.
MOST_CELLS = 4096
ROUNDS = 8


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that can be compared: id, label, dimension, digest of label and vector, unit vector as bytes of doubles."""
    for batch in batches:
        out: list[tuple] = []
        for vec_id, label, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if label is None or not v or None in v:
                continue
            x = np.array(v, np.float64) + 0.0  # no negative zeros
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0:
                continue
            x = x / top
            x /= np.sqrt(x @ x)
            raw = x.tobytes()
            out.append((vec_id, label, len(x), hashlib.blake2b(raw + label.encode(), digest_size=16).digest(), raw))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["vec_id", "label", "dim", "digest", "unit"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors; a cell that loses all its vectors starts anew at the worst-placed one."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        sim = x @ c.T
        home = sim.argmax(1)
        best = sim[np.arange(len(x)), home]
        c = np.zeros_like(c)
        np.add.at(c, home, x)
        norm = np.sqrt((c * c).sum(1))
        empty = np.flatnonzero(norm < 1e-12)
        if len(empty):
            c[empty] = x[np.argsort(best)[: len(empty)]]
            norm[empty] = 1.0
        c /= norm[:, None]
    return np.unique(c, axis=0)


def _place(centroids: dict[int, np.ndarray], cosine: float):
    """A row for each cell in which a vector must be compared, and whether it is its home."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            rows, cells, homes = [], [], []
            units = batch.column(3).to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                c = centroids.get(int(dim))
                if c is None:
                    rows.append(at)
                    cells.append(np.zeros(len(at), np.int32))
                    homes.append(np.ones(len(at), bool))
                    continue
                x = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), dim)
                sim = x @ c.T
                home = sim.argmax(1)
                apart = np.sqrt(np.maximum(1e-24, 2 - 2 * (c @ c.T)))
                # distance to the plane between the home's and the other centroid
                far = (sim[np.arange(len(at)), home][:, None] - sim) / apart[home]
                r, cell = np.nonzero((far <= reach) | (np.arange(len(c)) == home[:, None]))
                rows.append(at[r])
                cells.append(cell.astype(np.int32))
                homes.append(cell == home[r])
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(take) for i in (0, 1, 2, 3, 4)], pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes))], ["class", "label", "dim", "unit", "copies", "cell", "home"]
                )

    return run


def link_block(home: np.ndarray, home_class: np.ndarray, other: np.ndarray, other_class: np.ndarray, copies: np.ndarray, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each home vector to the others (copies counted), and edges that span the same groups as the links."""
    near = np.zeros((len(home), len(other)), bool)
    for a in range(0, len(home), 512):
        near[a : a + 512] = home[a : a + 512] @ other.T >= cosine
    near &= home_class[:, None] != other_class[None, :]
    links = near @ copies
    edges: list[tuple[int, int]] = []
    todo = links > 0
    while todo.any():
        row = np.zeros(len(home), bool)
        front = np.zeros(len(home), bool)
        front[todo.argmax()] = True
        col = np.zeros(len(other), bool)
        while front.any():
            row |= front
            fresh = near[front].any(0) & ~col
            col |= fresh
            front = near[:, fresh].any(1) & ~row
        todo &= ~row
        nodes = np.unique(np.concatenate([home_class[row], other_class[col]]))
        edges += [(int(nodes[0]), int(x)) for x in nodes[1:]]
    return links, edges


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        dim = table.column("dim")[0].as_py() if table.num_rows else 1
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(-1, dim)
        cls, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        h, o = side == 0, side == 1
        links, edges = link_block(x[h], cls[h], x[o], cls[o], copies[o], cosine)
        some = links > 0
        a = np.concatenate([cls[h][some], np.array([e[0] for e in edges], np.int64)])
        b = pa.array([None] * int(some.sum()) + [e[1] for e in edges], pa.int64())
        n = pa.array(np.concatenate([links[some], np.zeros(len(edges), np.int64)]))
        return pa.table({"class": pa.array(a), "n": n, "to": b})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Rows with equal labels are linked if their cosine is at least `cosine`, in
    double precision.  Rows without label, and vectors that are null, empty,
    zero or hold null or non-finite components, are linked with nothing, and so
    are vectors of different lengths.  Equal vectors are linked with each other.
    Rows that repeat an id are vectors of their own that share the id.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    units = materialize(rows.mapInArrow(_units, "vec_id long, label string, dim int, digest binary, unit binary"), "vector-units")
    classes = units.groupBy("digest", "label", "dim").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    classes = materialize(classes, "vector-classes")
    numbers = Numbers(classes)
    classes = numbers.add(classes)

    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter(f"most > {CELL}").collect()
    centroids: dict[int, np.ndarray] = {}
    for s in sizes:
        draw = F.pmod(F.xxhash64("class"), F.lit(1 << 30)) / float(1 << 30)
        got = classes.filter((F.col("dim") == s.dim) & (draw < min(1.0, SAMPLE / s.n))).select("class", "unit").collect()
        x = np.array([np.frombuffer(r.unit, np.float64) for r in sorted(got, key=lambda r: r["class"])]).reshape(-1, s.dim)
        if len(x):
            centroids[s.dim] = spherical_kmeans(x, min(MOST_CELLS, -(-s.most // CELL)))

    placed = classes.select("class", "label", "dim", "unit", "copies").mapInArrow(_place(centroids, cosine), "class long, label string, dim int, unit binary, copies long, cell int, home boolean")
    placed = materialize(placed, "vector-cells")
    cells = placed.groupBy("label", "dim", "cell").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count("*").alias("members"))
    cells = cells.select("label", "dim", "cell", F.ceil(F.col("homes") / BLOCK).cast("int").alias("home_blocks"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    member = placed.join(cells, ["label", "dim", "cell"])
    own = F.pmod(F.xxhash64("class", F.lit(3)), F.greatest(F.col("home_blocks"), F.lit(1)))
    other = F.pmod(F.xxhash64("class", F.lit(4)), F.col("blocks"))
    key = ["label", "dim", "cell"]
    left = member.filter("home").select(*key, own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("j"), F.lit(0).alias("side"), "class", "copies", "unit")
    right = member.filter("home_blocks > 0").select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("home_blocks").cast("long") - 1)).alias("i"), other.alias("j"), F.lit(1).alias("side"), "class", "copies", "unit")
    found = left.unionByName(right).groupBy(*key, "i", "j").applyInArrow(_compare(cosine), "class long, n long, to long")
    found = materialize(found, "vector-links")

    groups = connected_components(found.filter("to is not null").select("class", "to"), "class", "to")
    direct = found.filter("to is null").groupBy("class").agg(F.sum("n").alias("links"))
    member = classes.select("class", "copies", "least_id").join(groups.withColumnRenamed("node", "class"), "class", "left")
    member = member.select("class", "copies", "least_id", F.coalesce("component", "class").alias("root"))
    smallest = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    member = member.join(smallest, "root").join(direct, "class", "left")
    of_class = member.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # rows that can't be compared carry no class; an id may stand in rows of both kinds
    # a vector that very many rows have is sent to them
    compared = join_unique(numbers.add(units.select("vec_id", "digest")), materialize(of_class, "vector-components"), "class").select("vec_id", "n_links", "component_id")
    ok = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    alone = rows.filter(~F.coalesce(ok, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = compared.unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))
