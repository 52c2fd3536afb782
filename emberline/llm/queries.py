"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.chat_events import fold_events, masked_texts, read_back, render
from emberline.llm.class_lm import class_scores
from emberline.llm.embedding_dedup import near_vectors
from emberline.llm.hash_tree import shard_rows
from emberline.llm.language_id import languages
from emberline.llm.minhash_forest import near_duplicates
from emberline.llm.positional_index import contamination
from emberline.llm.soft_mixing import fit_mixer, mix
from emberline.llm.suffix_dedup import repeated_bytes
from emberline.llm.token_cache import token_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"), cosine=0.93)


_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN n ON n.a = comp.vec_id
"""


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(_read(spark, sf_dir, "documents"))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates for four fifths of the tokens of high and one fifth of low quality, nothing toxic."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    mixer = fit_mixer(docs, _read(spark, sf_dir, "labels"), {"toxic": 0.0, "low": 0.2, "high": 0.8})
    return mix(docs, mixer, ["doc_id"])


def op5_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_read(spark, sf_dir, "documents"))


def _as_log(rows: DataFrame) -> DataFrame:
    """An event log whose final messages are the rows: what each row says is drafted, streamed, edited or written anew.

    By a hash of the row, a message is written at once, or streamed in three
    deltas, or drafted and then edited, or a streamed draft is regenerated and
    streamed again, or deleted and written again.  target numbers the messages of
    a conversation by turn, role and text.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    rows = rows.withColumn("target", number).withColumn("way", F.pmod(F.xxhash64("conv_id", "target"), F.lit(5)))
    n = F.length("text")
    third = lambda k: F.substring("text", F.floor(n * k / 3).cast("int") + 1, (F.floor(n * (k + 1) / 3) - F.floor(n * k / 3)).cast("int"))
    event = lambda kind, text, role="role": F.struct(F.lit(kind).alias("kind"), (F.col(role) if role == "role" else F.lit(role)).alias("role"), text.alias("text"))
    draft, streamed = F.concat(F.reverse("text"), F.lit(" </s>?")), [event("delta", third(k), "") for k in (0, 1, 2)]
    ways = [
        F.array(event("message", F.col("text"))),
        F.array(event("message", F.lit("")), *streamed),
        F.array(event("message", draft), event("delta", F.lit("...")), event("edit", F.col("text"))),
        F.array(event("message", F.lit("")), event("delta", draft), event("regenerate", F.lit(""), ""), *streamed),
        F.array(event("message", draft), event("delete", F.lit("")), event("message", third(0)), *streamed[1:]),
    ]
    chosen = F.when(F.col("way") == 0, ways[0])
    for k in (1, 2, 3):
        chosen = chosen.when(F.col("way") == k, ways[k])
    log = rows.select("conv_id", "turn", "target", F.posexplode(chosen.otherwise(ways[4])).alias("step", "e"))
    return log.select("conv_id", F.struct("turn", "step").alias("seq"), "target", "e.kind", "e.role", "e.text")


def op8_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows as logs of events, folded, rendered and read back. Rows that repeat a turn each stand for a message."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = rows.unionByName(own).withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    done = render(fold_events(_as_log(rows))).select("conv_id", "formatted", "loss_spans")
    done = done.withColumns({"turns": read_back(F.col("formatted")), "under_mask": F.concat_ws("", masked_texts(F.col("formatted"), F.col("loss_spans")))})
    turns = F.concat_ws("", F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("under_mask").cast("long").alias("loss_chars"),
        F.sha2("under_mask", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_OP8 = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(20 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
         + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

_OP6 = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM iw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT d.doc_id, win.item_id, g.i, g.n FROM (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)) g
  JOIN win ON win.s = g.s AND win.n = g.n JOIN dw d ON d.doc_id = g.doc_id),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM occ, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_read(spark, sf_dir, "documents"), shards=8)


def _draw_sql(path: str, weight: float) -> str:
    return f"(-ln((('0x' || substr(md5(k || '|{path}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight!r})"


def _tree_sql(shards: int, grown: bool) -> str:
    """The shard of the key k: the least draw of the regions, of its racks, of their shards (two in a rack, two racks in a region)."""

    def least(options: list[tuple[str, float, str]]) -> str:
        if len(options) == 1:
            return options[0][2]
        draws = "[" + ", ".join(_draw_sql(path, w) for path, w, _ in options) + "]"
        return f"CASE list_position({draws}, list_min({draws})) " + " ".join(f"WHEN {i + 1} THEN {x}" for i, (_, _, x) in enumerate(options)) + " END"

    regions = []
    for r in range(shards // 4):
        racks = [(f"/r{r}/k{k}", 2.0, least([(f"/r{r}/k{k}/{x}", 1.0, str(x)) for x in (2 * k, 2 * k + 1)])) for k in (2 * r, 2 * r + 1)]
        regions.append((f"/r{r}", 4.0, least(racks)))
    return least([*regions, (f"/g{shards}", 1.0, str(shards))] if grown else regions)


#: crc32 by its table of 256 values, which the polynomial gives.
_OP9 = f"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS v, 0 AS n FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, n + 1 FROM bits WHERE n < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE n = 8),
d AS MATERIALIZED (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c // 256, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM documents, tab),
s AS (SELECT *, ({_tree_sql(8, False)})::INT AS shard, ({_tree_sql(8, True)})::INT AS grown_shard, ('0x' || substr(md5(k || '#' || crc), 1, 8))::BIGINT AS o FROM d)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY o, doc_id NULLS FIRST, crc) - 1 AS slot, grown_shard FROM s
"""


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), words=5, percent=85)


_OP10 = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM dw, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_class_lm": op2_class_lm,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_soft_mixing": op4_soft_mixing,
    "op5_token_cache": op5_token_cache,
    "op6_positional_index": op6_positional_index,
    "op7_language_id": op7_language_id,
    "op8_chat_events": op8_chat_events,
    "op9_hash_tree": op9_hash_tree,
    "op10_minhash_forest": op10_minhash_forest,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": _OP1,
    "op6_positional_index": _OP6,
    "op8_chat_events": _OP8,
    "op9_hash_tree": _OP9,
    "op10_minhash_forest": _OP10,
}
