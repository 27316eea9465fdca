"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs in local mode, as in tests, one is made and set; a cluster without the
    setting raises, since a machine's own folder would be lost with it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="folioframe-")
    sc.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


MAX_BROADCAST, MAX_BYTES = 500_000, 64 << 20  # a table of more rows or bytes is joined by a shuffle


def checked(df: DataFrame, rows: int = MAX_BROADCAST, size: int = MAX_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows and bytes, which are counted, are within the limits; else as it is."""
    wide = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 16 if f.dataType.simpleString() == "string" else F.lit(16) for f in df.schema]
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(reduce(Column.__add__, wide))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """As cut_lineage, in columns that are compressed, for tables that ``remove`` deletes by the path that is returned too."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's text, modulo n (null stays null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *columns: Column) -> Column:
    """Hex digits whose order is a shuffle of the columns' values fixed by the seed (null: as the text 'null')."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]))


def running(df: DataFrame, order: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """df with ``__row``, its place in the order (from 1), and for each name in ``sums`` the column's sum over all rows
    before it. The rows are sorted in ranges and written; only one row a range is summed in a single task.

    The order must be total up to rows that are interchangeable. Runs jobs when called."""
    sums = sums or {}
    placed = cut_lineage(df.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__o_{n}") for n, c in sums.items()])
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = own.select("__part", ahead("__n").alias("__o"), *[ahead(f"__o_{n}").alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order)
    # One row a range of the sort, of which there are as many as shuffle partitions.
    out = placed.join(F.broadcast(offsets), "__part").withColumn("__row", F.col("__o") + F.row_number().over(inside))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({n: F.col(f"__o_{n}") + F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()}) if sums else out
    return out.drop("__part", "__o", *[f"__o_{n}" for n in sums])


def null_last_key(column: Column) -> Column:
    """A never-null string that sorts by code point with null last."""
    return F.when(column.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column.cast("string")))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less any columns of the names that an operator is about to add (its own columns win)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
