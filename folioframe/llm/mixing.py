"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: the sources' weights share the corpus's size; no source gives more than REPEATS times its own size, and
what is above is shared again by weight (water filling over the sources sorted by the level at which they are full).

Quotas: the mix has blocks of equal size. The block with the highest quotient target / (2k + 1) is next, and every run
of ``blocks // shards`` blocks is a shard, so each shard has integer quotas of each source. A source whose target is
below FINE blocks would be missed by more than about a word in FINE; it is apportioned in blocks of one word, the same
number to each shard up to one word, and the others share the rest.

Selection: a source's documents, shuffled by seed, form a stream that repeats REPEATS times and is cut into the source's
blocks. Rounds that the quotas fill are taken whole; of the round after them the seed chooses as many blocks as are left
to take. The seed then deals the chosen blocks to the shards until each has its quota. What a document gives follows
from its place in the stream, which comes from sums over buckets of the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut_lineage, n_words, null_last_key, running, seeded, table
from .shards import bucket

SHARDS = 16
BLOCKS = 32_768  # blocks of the whole mix, at most
FINE = 200  # a source with a target of fewer blocks is taken in blocks of one word
REPEATS = 3
WEIGHTS = (1, 2, 3)  # of the sources by name, repeating
SEED = 30


def source_targets(sizes: DataFrame) -> tuple[DataFrame, int]:
    """(__k, source_size) with weight, cap and target, and the total of all sizes. Runs jobs when called."""
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("__row") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighted = running(sizes, ["__k"]).withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * REPEATS}).drop("__row")
    weighted = weighted.withColumn("__level", F.col("cap") / F.col("weight"))
    by_level = cut_lineage(running(weighted, ["__level", "__k"], {"__caps": "cap", "__weights": "weight"}))
    total, weights = by_level.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weights = total or 0, weights or 0
    # Sources before this one are full: the rest of the total is shared by the weights from here on.
    rest, still = F.lit(total) - F.col("__caps"), F.lit(weights) - F.col("__weights")
    fits = by_level.where(rest * F.col("weight") <= F.col("cap") * still)
    first = fits.agg(F.min(F.struct("__level", "__k", rest.alias("rest"), still.alias("open"))).alias("f")).first().f
    level = F.lit(first.rest).cast("long") * F.col("weight") / F.lit(first.open).cast("long") if first else F.lit(None).cast("double")
    target = F.when(level.isNull() | (level > F.col("cap")), F.col("cap").cast("double")).otherwise(level)
    return by_level.withColumn("target", target).select("__k", "source_size", "weight", "cap", "target"), total


@dataclass(frozen=True)
class Plan:
    """What the mix takes. ``sources``: __k, source_size, target, words (of a source that is taken by the word, else
    null), k (its blocks), rounds (that are taken whole). ``chosen``: __k, j (block of the repeated stream) and shard,
    at most BLOCKS rows. ``block``: words of a block."""

    sources: DataFrame
    chosen: DataFrame
    block: int
    shards: int


def plan(sizes: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> Plan:
    """The plan for sources (__k, source_size). Runs jobs when called."""
    targets, total = source_targets(sizes)
    block = max(-(-total // blocks), 1)
    small = F.lit(block > 1) & (F.col("target") < FINE * block)
    sized = cut_lineage(targets.withColumn("words", F.when(small, F.round("target")).cast("long")))
    n = (total - (sized.agg(F.sum("words")).first()[0] or 0)) // block
    seats = _seats(sized, block, n, shards)
    held = seats.groupBy("__k").agg(F.count(F.lit(1)).alias("k"))
    size, own = F.col("source_size"), Window.partitionBy("__k")
    taken = F.coalesce("words", F.col("k") * block)
    sources = sized.join(held, "__k", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    sources = cut_lineage(sources.withColumn("rounds", F.when(size > 0, F.floor(taken / size)).otherwise(0)).select("__k", "source_size", "target", "words", "k", "rounds"))
    # Blocks that begin in a round taken whole are taken; those that begin in the next one may be.
    begun = lambda r: F.expr(f"({r} * source_size + {block - 1}) div {block}")
    ends = F.least(begun("(rounds + 1)"), F.expr(f"{REPEATS} * source_size div {block}"))
    open_ = sources.where("k > 0").select("__k", "k", begun("rounds").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(ends, F.col("k")) - 1)).alias("j"))
    fate = F.row_number().over(own.orderBy(F.col("j") >= F.col("whole"), F.when(F.col("j") >= F.col("whole"), seeded(seed, F.col("__k"), F.col("j"))), "j"))
    chosen = open_.withColumn("fate", fate).where("fate <= k")
    dealt = chosen.withColumn("i", F.row_number().over(own.orderBy(seeded(seed + 1, F.col("__k"), F.col("j")), "j")) - 1)
    return Plan(sources, cut_lineage(dealt.join(seats, ["__k", "i"]).select("__k", "j", "shard")), block, shards)


def _seats(sized: DataFrame, block: int, n: int, shards: int) -> DataFrame:
    """(__k, i, shard): a row for each block of the mix, numbered within its source in the order of the shards.

    Sources with blocks have FINE each or more (or blocks are words), so at most BLOCKS and a few rows are ranked."""
    most = F.least(F.floor(F.col("target") / block + 0.5) + 1, F.expr(f"cap div {block}")).cast("int")
    asked = sized.where(F.col("words").isNull() & (most > 0)).withColumn("i", F.explode(F.sequence(F.lit(0), most - 1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("target") / (2 * F.col("i") + 1)).desc(), "__k")) - 1
    return cut_lineage(asked.withColumn("rank", rank).where(F.col("rank") < n).select("__k", "i", F.floor(F.col("rank") * shards / max(n, 1)).cast("int").alias("shard")))


def _turn(shards: int) -> Column:
    """The shard at which a source that is taken by the word begins, so that odd words do not all go to one shard."""
    return F.conv(F.substring(F.md5("__k"), 1, 4), 16, 10).cast("int") % shards


def shard_quotas(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """(shard, source, quota, block): the blocks of ``block`` words that each shard takes of each source."""
    made = plan(_sizes(_buckets(_placed(docs))), shards, blocks)
    quotas = made.chosen.groupBy("shard", "__k").agg(F.count(F.lit(1)).alias("quota")).withColumn("block", F.lit(made.block).cast("long"))
    split = made.sources.where("words > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    split = split.withColumn("quota", F.expr(f"words * (i + 1) div {shards} - words * i div {shards}")).where("quota > 0")
    quotas = quotas.unionByName(split.select(((F.col("i") + _turn(shards)) % shards).alias("shard"), "__k", "quota", F.lit(1).cast("long").alias("block")))
    return quotas.select("shard", F.when(F.col("__k") != "1", F.substr(F.col("__k"), F.lit(2))).alias("source"), "quota", "block")


def _placed(docs: DataFrame, ties: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """docs (with doc_id, source and __size) and their source's key, place in the shuffle and bucket."""
    keyed = docs.withColumns({"__k": null_last_key(F.col("source")), "__h": seeded(seed, F.col("doc_id"), *map(F.col, ties))})
    return keyed.withColumn("__b", bucket(F.col("__h")))


def _buckets(placed: DataFrame) -> DataFrame:
    return placed.groupBy("__k", "__b").agg(F.sum("__size").alias("__n"))


def _sizes(per_bucket: DataFrame) -> DataFrame:
    return per_bucket.groupBy("__k").agg(F.sum("__n").alias("source_size"))


def _streams(docs: DataFrame, ties: tuple[str, ...], seed: int, shards: int, blocks: int) -> tuple[DataFrame, Plan]:
    """docs with the plan's columns of their source, __at (place in the source's stream) and __row (in its bucket)."""
    placed = _placed(docs, ties, seed)
    per_bucket = cut_lineage(_buckets(placed))
    made = plan(_sizes(per_bucket), shards, blocks, seed)
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_bucket.withColumn("__before", ahead).join(made.sources, "__k").drop("__n")
    within = Window.partitionBy("__k", "__b").orderBy("__h", "doc_id", *ties)
    earlier = F.coalesce(F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(offsets, ["__k", "__b"]).withColumns({"__at": F.col("__before") + earlier, "__row": F.row_number().over(within)}), made


def mix(docs: DataFrame, ties: tuple[str, ...] = (), seed: int = SEED, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, source, the columns of ``ties``, size, source_size, target, taken and shards of every row of docs (with
    doc_id, source and __size, the words of the text).

    ``shards`` lists (shard, words) of the words that each shard takes of the row, by shard; ``taken`` is their sum,
    repeats counted, at most REPEATS times the size. A source's words are its quotas exactly, which differ from its
    target by a block or two (1 / BLOCKS of the corpus), and if the target is below FINE blocks by less than a word. A
    null source is one of its own, the last. Null sizes count as 0; rows without a word are not taken. Rows that are
    equal in doc_id and ``ties`` are interchangeable. An empty table gives no rows; other columns are left out, so none
    can clash. docs is read twice; runs jobs when called.
    """
    base = docs.select("doc_id", "source", *[c for c in ties if c != "__size"], F.coalesce("__size", F.lit(0)).cast("long").alias("__size"))
    rows, made = _streams(base, ties, seed, shards, blocks)
    block, d, s = made.block, F.col("words"), made.shards
    # Blocks of one source that the row meets in each round, as numbers of the repeated stream; of a source that is
    # taken by the word, the shards' runs of words.
    spans = F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), lambda r: F.struct((r * F.col("source_size") + F.col("__at")).alias("lo"), (r * F.col("source_size") + F.col("__at") + F.col("__size")).alias("hi")))
    rows = rows.withColumn("m", F.explode_outer(F.when(F.col("__size") > 0, spans))).withColumns({"lo": F.col("m.lo"), "hi": F.col("m.hi")})
    run_of = lambda x: F.expr(f"(({x} + 1) * {s} - 1) div words")
    j = F.when(d.isNull(), F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))).when(F.col("lo") < d, F.sequence(run_of("lo"), run_of("least(hi, words) - 1")))
    rows = rows.withColumn("j", F.explode_outer(F.when(F.col("lo").isNotNull(), j)))
    # At most BLOCKS rows.
    chosen = F.broadcast(made.chosen.select(F.col("__k").alias("__ck"), F.col("j").alias("__cj"), F.col("shard").alias("__s")))
    rows = rows.join(chosen, d.isNull() & (F.col("__k") == F.col("__ck")) & (F.col("j") == F.col("__cj")), "left")
    begin = F.when(d.isNull(), F.col("j") * block).otherwise(F.expr(f"words * j div {s}"))
    end = F.when(d.isNull(), (F.col("j") + 1) * block).otherwise(F.expr(f"words * (j + 1) div {s}"))
    shard = F.when(d.isNull(), F.col("__s")).otherwise(((F.col("j") + _turn(s)) % s).cast("int"))
    cut = rows.withColumns({"shard": shard, "w": F.least("hi", end) - F.greatest("lo", begin)})
    ident = ["__k", "__b", "__row"]
    named = [F.first(c).alias(c) for c in dict.fromkeys(("doc_id", *ties, "__size", "source_size", "target"))]
    per = cut.groupBy(*ident, "shard").agg(*named, F.sum("w").alias("w"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("shard", F.col("w").alias("words")))))
    out = per.groupBy(*ident).agg(*named, F.coalesce(F.sum(F.when(F.col("shard").isNotNull(), F.col("w"))), F.lit(0)).alias("taken"), pieces.alias("shards"))
    return out.select("doc_id", F.when(F.col("__k") != "1", F.substr(F.col("__k"), F.lit(2))).alias("source"), *[c for c in ties if c != "__size"], F.col("__size").alias("size"), "source_size", "target", "taken", "shards")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """mix of all documents, with ``shards`` as text: shard:words, by shard. Null texts have size 0."""
    docs = cut_lineage(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("__size")))
    listed = F.array_join(F.transform("shards", lambda p: F.concat_ws(":", p["shard"].cast("string"), p["words"].cast("string"))), " ")
    return mix(docs, ties=("__size",)).withColumn("shards", listed)


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as whole documents, each as often as a block is chosen that holds its first word (of a source that is
    taken by the word: a word in its middle), REPEATS times at most. Columns and texts stay as they are.

    A source's words differ from its quotas by the documents at the edges of blocks. Rows without a word are not taken;
    repeated rows are rows of their own; an empty table gives no rows; other columns may have any names. Runs jobs when
    called.
    """
    # The input's columns are kept in one struct meanwhile, so that no name can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all")
    held = docs.select("doc_id", "source", n_words(F.col("text")).alias("__size"), F.xxhash64("text").alias("__t"), whole)
    rows, made = _streams(held, ("__size", "__t"), seed, SHARDS, BLOCKS)
    rows = rows.where("__size > 0")
    for r in (0, 1):  # rounds that are taken whole hold no block that is not chosen
        # At most BLOCKS rows.
        chosen = F.broadcast(made.chosen.select(F.col("__k").alias("__ck"), F.col("j").alias("__cj"), F.lit(1).alias(f"__in{r}")))
        place = F.expr(f"((rounds + {r}) * source_size + __at) div {made.block}")
        rows = rows.join(chosen, F.col("words").isNull() & (F.col("__k") == F.col("__ck")) & (place == F.col("__cj")), "left").drop("__ck", "__cj")
    late = F.when(F.col("rounds") + 1 < REPEATS, F.coalesce("__in1", F.lit(0))).otherwise(0)
    by_block = F.col("rounds") + F.when(F.col("rounds") < REPEATS, F.coalesce("__in0", F.lit(0)) + late).otherwise(0)
    by_word = F.col("rounds") + (F.col("words") - F.col("rounds") * F.col("source_size") > F.col("__at") + F.expr("__size div 2")).cast("int")
    copies = F.when(F.col("words").isNull(), by_block).otherwise(by_word).cast("int")
    return rows.where(copies > 0).withColumn("__c", F.explode(F.sequence(F.lit(1), copies))).select("__all.*")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INTEGER] AS w, (sum(source_size) OVER ())::BIGINT AS total, source_size * 3 AS cap FROM s),
l AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS op FROM w),
f AS (SELECT rest, op FROM l WHERE rest * w <= cap * op ORDER BY cap / w, k LIMIT 1),
t AS (
  SELECT l.k, source_size, l.w, total, cap, greatest(ceil(total / {BLOCKS}), 1)::BIGINT AS block,
         CASE WHEN f.op IS NULL OR (f.rest * l.w)::DOUBLE / f.op::DOUBLE > cap THEN cap::DOUBLE ELSE (f.rest * l.w)::DOUBLE / f.op::DOUBLE END AS target
  FROM l LEFT JOIN f ON true),
u AS (SELECT *, CASE WHEN block > 1 AND target < {FINE} * block THEN round(target)::BIGINT END AS words FROM t),
v AS (SELECT *, (total - coalesce(sum(words) OVER (), 0)::BIGINT) // block AS n FROM u),
a AS (SELECT k, block, n, target, unnest(range(0, least(floor(target / block + 0.5) + 1, cap // block)::BIGINT)) AS i FROM v WHERE words IS NULL),
q AS (SELECT k, i, r * {SHARDS} // n AS shard FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, k) - 1 AS r FROM a) WHERE r < n),
src AS (
  SELECT v.*, coalesce(kk, 0) AS kk, CASE WHEN source_size > 0 THEN coalesce(words, kk * block, 0) // source_size ELSE 0 END AS rounds
  FROM v LEFT JOIN (SELECT k, count(*) AS kk FROM q GROUP BY k) USING (k)),
c AS (
  SELECT k, kk, (rounds * source_size + block - 1) // block AS whole,
         unnest(range(0, least(((rounds + 1) * source_size + block - 1) // block, cap // block)::BIGINT)) AS j
  FROM src WHERE kk > 0),
chosen AS (
  SELECT k, j FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY j >= whole, CASE WHEN j >= whole THEN md5('{SEED}:' || k || ':' || j) END NULLS FIRST, j) AS fate FROM c)
  WHERE fate <= kk),
dealt AS (SELECT k, j, shard FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5('{SEED + 1}:' || k || ':' || j), j) - 1 AS i FROM chosen) JOIN q USING (k, i)),
p AS (
  SELECT row_number() OVER () AS rid, d.*, source_size, target, block, words,
         coalesce(sum(size) OVER (PARTITION BY d.k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot
  FROM (SELECT *, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size) AS h FROM d) d JOIN src ON src.k = d.k),
m AS (SELECT *, r * source_size + spot AS lo, r * source_size + spot + size AS hi FROM p, range(3) x(r) WHERE size > 0),
pieces AS (
  SELECT rid, shard, least(hi, (j + 1) * block) - greatest(lo, j * block) AS n
  FROM (SELECT *, unnest(range(lo // block, (hi - 1) // block + 1)) AS j FROM m WHERE words IS NULL) JOIN dealt USING (k, j)
  UNION ALL
  SELECT rid, (i + ('0x' || substr(md5(k), 1, 4))::INTEGER % {SHARDS}) % {SHARDS}, least(hi, words * (i + 1) // {SHARDS}) - greatest(lo, words * i // {SHARDS})
  FROM m, range({SHARDS}) y(i) WHERE words IS NOT NULL AND least(hi, words * (i + 1) // {SHARDS}) > greatest(lo, words * i // {SHARDS})),
per AS (SELECT rid, sum(n) AS taken, string_agg(shard || ':' || n, ' ' ORDER BY shard) AS shards FROM (SELECT rid, shard, sum(n)::BIGINT AS n FROM pieces GROUP BY rid, shard) GROUP BY rid)
SELECT doc_id, source, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shards, '') AS shards
FROM p LEFT JOIN per USING (rid)
"""
