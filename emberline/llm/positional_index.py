"""Benchmark decontamination with a distributed positional inverted index.

The index stores a posting (term, document, position) for every occurrence of a
term of the test set in the corpus, in one pass over it.  A test phrase (a
window of words) is found by intersecting the lists of its terms, each moved
back by the term's place in the phrase, from the rarest term on: the rarest
gives the places where the phrase may start, the next rarest keeps those that
it has, too, and the few that are left are held against all other terms.  Only
SQL functions are used.

Postings stay with their documents, so building the index shuffles nothing, and
terms are numbers, so equal numbers are equal words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.plans.scratch import materialize

#: What stands between words once A-Z is lowered: every ASCII character that is no digit and no lower-case letter.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of numbers, or terms, up to which a table goes to all tasks; a larger one is shuffled.
SENT_ROWS, SENT_TERMS = 1_000_000, 300_000
#: Parts into which the rows of each term are dealt where the terms are too many to be sent.
SALTS = 16


def words_of(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED), BREAK), lambda w: w != "")


def _sent(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """df, marked to be sent to all tasks if its size allows it. df is a stored table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def windows(items: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, items): the distinct runs of n words of the items, and which items have them.

    An item of fewer words is one window, an item without words none.
    """
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col).cast("string")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


def build_index(docs: DataFrame, vocabulary: DataFrame, most_terms: int = SENT_TERMS) -> DataFrame:
    """The stored index: (doc_id, h, pos, term, n_words), a row for every occurrence of a term.

    docs: doc_id, t (the text); vocabulary: word, term (a number), a stored
    table.  h tells rows of one id with other texts apart.  Every document has
    besides a row with its number of words, and no term unless its first word has one.
    """
    words = docs.select("doc_id", F.xxhash64("t").alias("h"), words_of(F.col("t")).alias("w"))
    each = words.select("doc_id", "h", F.size("w").alias("n"), F.posexplode_outer("w").alias("pos", "word"))
    if vocabulary.limit(most_terms + 1).count() <= most_terms:
        found = each.join(F.broadcast(vocabulary), "word", "left")
    else:  # a very common word is dealt to several tasks
        salted = vocabulary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = each.withColumn("salt", F.pmod(F.coalesce("pos", F.lit(0)), F.lit(SALTS))).join(salted, ["word", "salt"], "left")
    first = F.coalesce("pos", F.lit(0)) == 0
    return materialize(found.filter(first | F.col("term").isNotNull()).select("doc_id", "h", "pos", "term", F.when(first, F.col("n")).alias("n_words")), "index-postings")


_DOC = ["doc_id", "h"]


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["h"].eqNullSafe(b["h"])


def _having(starts: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """The starts at which all `terms` of their phrase stand in the index.

    starts: doc_id, h, phrase, start; terms: phrase, o (place in it), term.  A
    phrase without any of the terms keeps its starts.  Starts grow with
    the corpus, so they meet the lists in a shuffle at every size.
    """
    starts = materialize(starts, "index-starts")
    need = starts.join(_sent(terms), "phrase").select(*_DOC, "phrase", "start", (F.col("start") + F.col("o")).alias("pos"), "term")
    need = materialize(need, "index-needed").hint("merge")
    lists = index.join(_sent(materialize(terms.select("term").distinct(), "index-terms")), "term", "left_semi")
    met = need.join(lists, _same_doc(need, lists) & (need["pos"] == lists["pos"]) & (need["term"] == lists["term"]))
    # rows that repeat id and text have each posting more than once
    got = met.groupBy(need["doc_id"], need["h"], "phrase", "start").agg(F.countDistinct(need["pos"]).alias("got"))
    asked = terms.groupBy("phrase").agg(F.count("*").alias("asked"))
    held = got.join(asked, "phrase").filter("got = asked").select(*_DOC, "phrase", "start")
    return held.unionByName(starts.join(_sent(materialize(asked.select("phrase"), "index-asked")), "phrase", "left_anti"))


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, h, phrase, start, length): every place where a phrase stands.

    index: build_index() of all terms; phrases: phrase, terms (array of numbers).
    """
    counts = materialize(index.filter("term is not null").groupBy("term").agg(F.count("*").alias("n")), "index-counts")
    each = phrases.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("o", "term")).join(counts, "term", "left")
    by_rarity = Window.partitionBy("phrase").orderBy(F.asc_nulls_first("n"), "o")
    ranked = each.withColumns({"rank": F.row_number().over(by_rarity), "least": F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("phrase"))})
    # a phrase with a term that the corpus doesn't have stands nowhere
    ranked = materialize(ranked.filter("least > 0").select("phrase", "length", "rank", "o", "term"), "index-ranked")
    part = lambda cond: materialize(ranked.filter(cond).select("phrase", "o", "term", "length"), "index-ranked")
    rarest, next_, others = part("rank = 1"), part("rank = 2"), part("rank > 2")
    starts = index.join(_sent(rarest), "term").select(*_DOC, "phrase", (F.col("pos") - F.col("o")).alias("start")).filter("start >= 0").distinct()
    for terms in (next_, others):
        starts = _having(starts, terms.select("phrase", "o", "term"), index)
    return materialize(starts.join(_sent(rarest.select("phrase", "length")), "phrase"), "index-matches")


def proximity_matches(docs: DataFrame, first: str, second: str, within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, other): places of the word `first` with the word `second` at most `within` words away.

    Words are compared after lowering A-Z.  A document without both gives no
    row; a place isn't near itself.  The two lists of a stored index are
    intersected by stretches of the positions.
    """
    spark = docs.sparkSession
    vocabulary = materialize(spark.createDataFrame(sorted({(first, 0), (second, 0 if second == first else 1)}), "word string, term long"), "index-terms")
    index = build_index(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")), vocabulary)
    width = within + 1
    a = index.filter("term = 0").withColumn("block", F.explode(F.array(*[F.floor(F.col("pos") / width) + k for k in (-1, 0, 1)])))
    b = index.filter(F.col("term") == (0 if second == first else 1)).select(F.col("doc_id").alias("other_id"), F.col("h").alias("other_h"), F.col("pos").alias("other"), F.floor(F.col("pos") / width).alias("other_block"))
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & F.col("h").eqNullSafe(F.col("other_h")) & (F.col("block") == F.col("other_block"))
    near = a.join(b, same & (F.abs(F.col("pos") - F.col("other")) <= within) & (F.col("pos") != F.col("other")))
    return near.select(F.col("doc_id").alias(id_col), "pos", "other")


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, ratio: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    A word is hit if it stands inside an occurrence of a window of an item;
    contaminated means n_hit > 0 and ratio * n_hit >= n_words.  A null or empty
    text has no words; an empty table of items hits nothing, an empty table of
    docs gives no rows.  Rows with one id and equal texts get equal results, rows
    with one id and other texts each their own.  A null id is an id like others.
    Other columns are ignored; a text of any length is read whole.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    phrases = materialize(windows(items, n, item_col).withColumn("phrase", F.monotonically_increasing_id()), "index-windows")
    vocabulary = materialize(phrases.select(F.explode("window").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "index-terms")
    numbered = phrases.select("phrase", F.posexplode("window").alias("o", "word")).join(vocabulary, "word")
    numbered = numbered.groupBy("phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "term"))), lambda x: x["term"]).alias("terms"))
    index = build_index(base, vocabulary)
    matches = phrase_matches(index, materialize(numbered, "index-phrases"))
    spans = matches.select(*_DOC, "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    by_doc = Window.partitionBy(*_DOC).orderBy("start", "end")
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    n_hit = spans.withColumn("new", covered).groupBy(*_DOC).agg(F.sum("new").alias("n_hit"))
    of = phrases.select("phrase", F.explode("items").alias("item"))
    in_items = matches.select(*_DOC, "phrase").distinct().join(of, "phrase").groupBy(*_DOC).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = n_hit.join(in_items, _same_doc(n_hit, in_items)).select(n_hit["doc_id"].alias("id"), n_hit["h"].alias("of"), "n_hit", "items")
    rows = index.filter("n_words is not null").select("doc_id", "h", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (rows["h"] == found["of"]), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), ((hit > 0) & (hit * ratio >= F.col("n_words"))).alias("contaminated")
    )
