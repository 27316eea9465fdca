"""Proportional stratified interleaving: every shard gets the corpus's mixture of sources.

Rows are shuffled by seed within their source and ranked; the r-th of n rows has the fractional rank (2r - 1) / 2n.
Sorted by it, the sources interleave in proportion, and the sequence is cut into equal runs, the shards. Ranks are
not taken over whole sources but over buckets of the shuffle with counts summed in front of them, so a source may
hold any share of the rows and no task sorts more than a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import null_last_key, seeded, table, without

SHARDS = 16
SEED = 20
DIGITS = 3  # leading hex digits of the shuffle that make a bucket: 4096 a source
CUTS = 4096  # equal ranges of the fractional rank; a row number is taken inside each


def bucket(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, DIGITS), 16, 10).cast("int")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source", doc_id: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard); shards differ by one row at most.

    A null source is a source of its own, after all others. doc_id and ``ties`` fix the shuffle, so rows of one doc_id
    (or of none) are spread by the rest; rows that are equal in all of these are interchangeable. An empty table gives no rows. Input columns named shard or slot
    are replaced; others may have any names.
    """
    kept = without(docs, ["shard", "slot"]).columns
    base = docs.select(*dict.fromkeys([source, doc_id, *ties]), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"))
    base = base.withColumns({"__k": null_last_key(F.col(source)), "__h": seeded(seed, F.col(doc_id), *map(F.col, ties))}).withColumn("__b", bucket(F.col("__h")))
    per = Window.partitionBy("__k")
    ahead = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = base.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("__n")).withColumns({"__before": ahead(per.orderBy("__b")), "__size": F.sum("__n").over(per)}).drop("__n")
    order = ["__h", doc_id, *ties]
    within = Window.partitionBy("__k", "__b").orderBy(*order)
    ranked = base.join(offsets, ["__k", "__b"]).withColumn("__rank", F.row_number().over(within) + F.col("__before"))
    ranked = ranked.withColumn("__rank", (2 * F.col("__rank") - 1) / (2 * F.col("__size"))).withColumn("__cut", F.floor(F.col("__rank") * CUTS).cast("int"))
    # The ranges number CUTS at any size of the data: one small task sums them.
    starts = ranked.groupBy("__cut").agg(F.count(F.lit(1)).alias("__n")).withColumns({"__before": ahead(Window.partitionBy(F.lit(0)).orderBy("__cut")), "__total": F.sum("__n").over(Window.partitionBy(F.lit(0)))}).drop("__n")
    place = F.row_number().over(Window.partitionBy("__cut").orderBy("__rank", "__k", *order)) - 1 + F.col("__before")
    placed = ranked.drop("__before").join(starts, "__cut").withColumn("slot", place.cast("long"))
    shard = F.expr(f"slot * {shards} div __total").cast("int")
    slot = F.col("slot") - F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("__row.*", "shard", slot.alias("slot"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes of the text plus 1) and text_crc32; a null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def sharded_documents(docs: DataFrame) -> DataFrame:
    """docs with all columns and size, text_crc32, shard and slot (input columns of these names are replaced).

    Null texts have size 1; repeated rows are rows of their own; an empty table gives no rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = without(docs, ["size", "text_crc32"]).withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    return interleave(base, ties=("text_crc32", "size"))


def op2_interleaved_shards(spark, sf_dir: str) -> DataFrame:
    """Law ``rows`` over all documents; equal texts are not kept together. Null texts have size 1; empty table: no rows."""
    placed = interleave(sized(table(spark, sf_dir, "documents")), ties=("text_crc32", "size"))
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

