"""Token counts through a digest cache.

A text's normalised content and the tokenizer's version each have a digest; the
pair is looked up in a stored table of counts.  Only distinct contents that the
table lacks are encoded, and their counts are appended.

Normalising collapses runs of ASCII white space, which the tokenizer drops
anyway.  Since white space always separates its pieces, a text's count is the
sum over its white-space chunks, and each worker encodes a chunk once for as
long as its bounded memo holds it.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import textkit as K
from emberline.operators.skew import join_unique
from emberline.plans.scratch import materialize, scratch_dir

#: Chunks that a worker's memo holds before it starts anew.
MEMO_CHUNKS = 400_000
CACHE_SCHEMA = "digest binary, version string, n_tokens long"

_memo: dict[str, tuple[object, dict[bytes, int]]] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _counter(path: str):
    """The worker's tokenizer and memo for a file."""
    if path not in _memo:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _memo[path] = (Tokenizer.from_file(path), {})
    return _memo[path]


def count_tokens(texts: list[bytes], path: str) -> list[int]:
    """Tokens of each UTF-8 text, without begin, end or added special tokens."""
    tok, memo = _counter(path)
    chunks = [t.split() for t in texts]
    new = list(set().union(*chunks) - memo.keys())
    if len(memo) + len(new) > MEMO_CHUNKS:
        memo.clear()
        new = list(set().union(*chunks))
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        memo.update(zip(part, (len(e) for e in encode([c.decode() for c in part], add_special_tokens=False)), strict=True))
    return [sum(map(memo.__getitem__, c)) for c in chunks]


def check_splits(path: str) -> None:
    """ValueError unless a tokenizer's pieces never hold white space and don't depend on it."""
    if not path.endswith(".json"):
        raise ValueError(f"{path}: only tokenizers whose pieces end at white space can be counted by chunks")
    tok, _ = _counter(path)
    for a, b in (("ab", "cd"), ("it's", "<|x|>"), ("é.", "1,2"), ("x", "(y")):
        parts = [len(tok.encode(t, add_special_tokens=False)) for t in (a, b)]
        if any(len(tok.encode(a + gap + b, add_special_tokens=False)) != sum(parts) for gap in (" ", "\n", "\t  ")):
            raise ValueError(f"{path}: the pieces of this tokenizer depend on white space, which counting by chunks doesn't know")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offs in K.text_slices(batch, "text"):
            raw = buf.tobytes()
            digest = [hashlib.blake2b(b" ".join(raw[s:e].split()), digest_size=16).digest() for s, e in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(offs[1:] - offs[:-1]), pa.array(digest, pa.binary())], ["doc_id", "n_bytes", "digest"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and packed content, each digest once for a slice of rows."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for _, _, buf, offs in K.text_slices(batch, "text"):
            raw, found = buf.tobytes(), {}
            for s, e in zip(offs[:-1], offs[1:], strict=True):
                content = b" ".join(raw[s:e].split())
                found.setdefault(hashlib.blake2b(content, digest_size=16).digest(), content)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([pack.compress(x) for x in found.values()], pa.binary())], ["digest", "content"])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            digest, content = batch.column(0), batch.column(1)
            a, size, held = 0, 0, []
            for i in range(batch.num_rows):
                held.append(unpack.decompress(content[i].as_py()))
                size += len(held[-1])
                if size >= 4 * K.SLICE_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([digest.slice(a, i + 1 - a), pa.array(count_tokens(held, path), pa.int64())], ["digest", "n_tokens"])
                    a, size, held = i + 1, 0, []

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def token_counts(docs: DataFrame, tokenizer: str, cache_dir: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    cache_dir is a Parquet table of counts in a folder that all executors
    share; None takes a new, empty one in the scratch folder.  Counts found
    there aren't computed again.  tokenizer: the file of a tokenizer that drops
    white space and never joins across it, else a ValueError, as counts are
    added up by white-space chunks.  A null or empty text has 0 bytes and 0 tokens.
    Repeated rows and ids each give a row.  Other columns are ignored.
    """
    spark = docs.sparkSession
    check_splits(tokenizer)
    cache_dir = cache_dir or f"{scratch_dir(spark)}/emberline/token-cache-{uuid.uuid4().hex}"
    version = tokenizer_version(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = materialize(rows.mapInArrow(_digests, "doc_id long, n_bytes long, digest binary"), "token-digests")

    def stored() -> DataFrame:
        table = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
        return table.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    contents = rows.select("text").mapInArrow(_contents, "digest binary, content binary").groupBy("digest").agg(F.first("content").alias("content"))
    if _exists(spark, cache_dir):
        contents = contents.join(stored(), "digest", "left_anti")
    fresh = contents.select("digest", "content").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_dir)
    # a content that very many rows have is sent to them
    out = join_unique(keyed, stored(), "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
