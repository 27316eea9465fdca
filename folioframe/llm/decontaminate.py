"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A test item is short and a document may be long, so Jaccard similarity says nothing; what counts is the share of
the item's shingles that the document holds. Items are partitioned by size (powers of two). An item of m shingles
may miss at most m * (100 - PERCENT) / 100 of them, so one more than the largest such number in its partition
would be the fewest of its smallest hashes of which every matching document holds one. The item's MinHash sketch has
twice as many: the share of them that a document holds estimates the containment, and a document that can match
holds all but those that the item may miss. Documents' shingle hashes are joined with the sketches; a document with
fewer shingles than an item needs is not compared with it. The few documents found are read again and their shingles
compared as text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import MAX_BROADCAST, SPACE, checked, cut_lineage, table

SHINGLE = 5
PERCENT = 80


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def _runs(words: Column, make, short: Sequence[int] = ()) -> Column:
    """make(n) of the start of every run of n words, n being SHINGLE and the lengths in ``short``; one for a text of
    fewer words; none without a word."""
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    return F.when(F.size(words) > 0, F.concat(*[F.transform(starts(n), make(n)) for n in (SHINGLE, *short)]))


def shingle_hashes(words: Column, short: Sequence[int] = ()) -> Column:
    return _runs(words, lambda n: lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]), short)


def shingle_texts(words: Column, short: Sequence[int] = ()) -> Column:
    return _runs(words, lambda n: lambda i: F.array_join(F.slice(words, i + 1, n), " "), short)


def short_lengths(items: DataFrame) -> list[int]:
    """The lengths below SHINGLE that occur among the items (column w): at most SHINGLE - 1 numbers."""
    return sorted(r.n for r in items.select(F.size("w").alias("n")).where(F.col("n").between(1, SHINGLE - 1)).distinct().collect())


def item_sketches(items: DataFrame) -> DataFrame:
    """(item_id, h, m, k, need): the k smallest of the item's m hashes, as its size partition asks, and how many of
    them a document holds at least that holds PERCENT of the item."""
    hashes = items.select("item_id", F.explode(shingle_hashes(F.col("w"))).alias("h")).distinct()
    own = Window.partitionBy("item_id")
    sized = hashes.select("item_id", "h", F.count("h").over(own).alias("m"), F.row_number().over(own.orderBy("h")).alias("r"))
    largest = F.pow(F.lit(2), F.length(F.bin("m"))).cast("long") - 1
    k = F.least(F.col("m"), 2 * (F.floor(largest * (100 - PERCENT) / 100) + 1))
    missed = F.expr(f"m * {100 - PERCENT} div 100")
    return sized.where(F.col("r") <= k).select("item_id", "h", "m", k.alias("k"), (k - missed).alias("need"))


def candidates(keyed: DataFrame, asked: DataFrame, short: Sequence[int]) -> DataFrame:
    """(doc_id, text_hash, item_id, estimate): documents (with their words w, n in all at most) and items whose sketch they hold as far as
    a match must; none that matches is left out. ``estimate`` is the containment by the sketch."""
    # The words are made below the explode, once a document; half the characters bound the words, and these the shingles.
    hashed = keyed.select("doc_id", "text_hash", "n", F.explode(shingle_hashes(F.col("w"), short)).alias("h"))
    met = hashed.join(checked(item_sketches(asked), MAX_BROADCAST), "h").where(F.col("n") * 100 >= F.col("m") * PERCENT)
    held = met.groupBy("doc_id", "text_hash", "item_id").agg(F.count_distinct("h").alias("held"), F.first("k").alias("k"), F.first("need").alias("need"))
    return held.where("held >= need").select("doc_id", "text_hash", "item_id", (F.col("held") / F.col("k")).alias("estimate"))


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, item_id, n_shared, n_item, containment) of every document and item with at least PERCENT.

    Words are compared in lower case. An item of fewer than SHINGLE words is one shingle, which is looked for among
    the runs of as many words of the documents; a null text or one without
    a word holds nothing and no item without a word is found. Rows are told apart by doc_id and text, so repeated
    rows count once and a null doc_id is an id of its own. Items that repeat an item_id pool their shingles. Empty
    tables give no rows; other columns of either table are left out.
    """
    keyed = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.floor((F.length(text) + 1) / 2).alias("n"), _words(F.col(text)).alias("w"))
    asked = items.select("item_id", _words(F.col("text")).alias("w"))
    short = short_lengths(asked)
    found = cut_lineage(candidates(keyed, asked, short))
    few = checked(found.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct(), MAX_BROADCAST)
    again = keyed.join(few, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")), "left_semi")
    exact = asked.select("item_id", F.explode(shingle_texts(F.col("w"))).alias("shingle")).distinct()
    sized = exact.withColumn("n_item", F.count("shingle").over(Window.partitionBy("item_id")))
    shared = again.select("doc_id", "text_hash", F.explode(shingle_texts(F.col("w"), short)).alias("shingle")).join(checked(sized, MAX_BROADCAST), "shingle")
    counted = shared.groupBy("doc_id", "text_hash", "item_id", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    hit = counted.where(F.col("n_shared") * 100 >= F.col("n_item") * PERCENT)
    return hit.withColumn("containment", F.col("n_shared") / F.col("n_item")).select("doc_id", "text_hash", "item_id", "n_shared", "n_item", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no item, with all their columns; null texts and texts without a word stay, and repeated
    rows stay or go together. An empty benchmark takes nothing away. Other columns may have any names.
    Runs jobs when called."""
    hits = cut_lineage(contaminated(docs, items, text, doc_id).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct())
    same = docs[doc_id].eqNullSafe(hits["__d"]) & (F.xxhash64(docs[text]) == hits["__t"])
    return docs.join(checked(hits, MAX_BROADCAST), same, "left_anti")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """contaminated for all documents and items; of texts that share a doc_id the fullest match. Runs jobs when called."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"), F.max("containment").alias("containment"))


_SHINGLES = """SELECT DISTINCT id, s FROM (
  SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM (SELECT {id} AS id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM {table} WHERE text IS NOT NULL))"""
SQL = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN b USING (s) JOIN n ON n.id = b.id GROUP BY d.id, b.id, n_item HAVING count(*) * 100 >= n_item * 80
"""
