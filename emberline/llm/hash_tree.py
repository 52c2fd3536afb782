"""Sharding with a hierarchical weighted hash tree.

A shard is reached by three weighted hash draws: region, rack, shard.  At each
level every child draws -ln(u)/weight from a hash of the key and the child's
name, and the least draw wins, so a child is chosen in proportion to its weight
and a change of weights moves keys only between the subtrees whose weights
changed.  A shard that is added makes a region of its own: keys move into it
and nowhere else.

Only SQL functions are used; the tree has a fixed, small size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.plans.scratch import materialize

#: Bits of a draw; 52 bits are exact in a double.
_BITS = 52
#: Rows of one shard that one task numbers, about.
BUCKET_ROWS = 50_000
#: Repeats of a row that are dealt out at once.
PIECE = 100_000


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree and its weight."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def default_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> list[Leaf]:
    """Shards 0..n-1 in racks and regions of equal sizes."""
    return [Leaf(s, f"r{s // (per_rack * racks_per_region)}", f"k{s // per_rack}") for s in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    s = 1 + max(x.shard for x in tree)
    return [*tree, Leaf(s, f"g{s}", f"g{s}", weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u)/weight with u in (0, 1) from the first 52 bits of a digest of key and name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, _BITS // 4), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(2**_BITS)) / weight


def _choose(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The value of the option with the least draw."""
    if len(options) == 1:
        return options[0][2]
    draws = F.array(*[F.struct(_draw(key, n, w).alias("d"), F.lit(i).alias("i")) for i, (n, w, _) in enumerate(options)])
    won = F.array_min(draws)["i"]
    return reduce(lambda rest, i: F.when(won == i, options[i][2]).otherwise(rest), range(len(options) - 2, -1, -1), options[-1][2])


def assign(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a string key."""

    def below(leaves: list[Leaf], levels: tuple[str, ...], path: str) -> Column:
        if not levels:
            return _choose(key, [(f"{path}/{x.shard}", x.weight, F.lit(x.shard)) for x in leaves])
        names = list(dict.fromkeys(getattr(x, levels[0]) for x in leaves))
        parts = [(n, [x for x in leaves if getattr(x, levels[0]) == n]) for n in names]
        return _choose(key, [(f"{path}/{n}", sum(x.weight for x in p), below(p, levels[1:], f"{path}/{n}")) for n, p in parts])

    return below(tree, ("region", "rack"), "")


def shard_rows(docs: DataFrame, shards: int = 8, tree: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    The law is `key`: the id and the tree decide the shard, so equal ids share
    one.  slot numbers the rows of a shard from 0 without gaps, in the order of
    a hash of id and text, then the id, then the text's checksum; rows that
    repeat id and text take neighbouring slots.  A null text has no bytes and
    checksum 0; a null id is the key of the empty string.  An empty table gives
    no rows.  Other columns are ignored.

    Rows that agree in all that is returned are counted, numbered as one, and
    dealt out again in pieces, so a row that is repeated often is no task's
    burden.  Numbers are given by shard and hash bucket, the number of buckets
    in proportion to the rows, so no task numbers a whole shard.
    """
    tree = tree or default_tree(shards)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), key.alias("_key")
    ).withColumns({"shard": assign(F.col("_key"), tree).cast("int"), "grown_shard": assign(F.col("_key"), grow(tree)).cast("int")})
    order = F.conv(F.substring(F.md5(F.concat("_key", F.lit("#"), F.col("text_crc32").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_order", order)
    distinct = rows.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard", "_order").agg(F.count("*").alias("_n"))
    distinct = materialize(distinct, "shard-rows")
    total = distinct.count()
    bits = max(0, (max(1, total // (len(tree) * BUCKET_ROWS))).bit_length())
    distinct = distinct.withColumn("_bucket", F.shiftright("_order", 32 - bits).cast("int"))
    sizes = distinct.groupBy("shard", "_bucket").agg(F.sum("_n").alias("n"))
    # a row for each shard and bucket: one in BUCKET_ROWS of the input's
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("shard", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("shard", "_bucket").orderBy("_order", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = distinct.join(F.broadcast(before) if (1 << bits) * len(tree) <= 1 << 20 else before, ["shard", "_bucket"])
    out = out.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(own), F.lit(0)))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / PIECE)))
    out = out.withColumn("_piece", piece)
    out = out.withColumn("_i", F.explode(F.sequence(F.col("_piece") * PIECE, F.least(F.col("_piece") * PIECE + PIECE, F.col("_n")) - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_i")).cast("long").alias("slot"), "grown_shard")
