"""Rule-based layout: lines get a type and join into blocks; lines are assigned to boxes; captions find their target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..sources.synthetic import HEIGHT, PAGE

LINE = [*PAGE, "line_index"]


def upper_median(column: Column) -> Column:
    """sorted[n / 2] of the positive values (an aggregate)."""
    held = F.sort_array(F.collect_list(F.when(column > 0, column)))
    return F.coalesce(F.get(held, F.floor(F.size(held) / 2).cast("int")), F.lit(0.0))


def wide_gaps(spans: DataFrame) -> DataFrame:
    """Lines with at least three spans and two gaps over max(16, 1.8 x height): they look like table rows."""
    w = Window.partitionBy(*LINE).orderBy("x0", "span_index")
    gap = F.col("x0") - F.lag("x1").over(w)
    wide = spans.withColumn("wide", (gap > F.greatest(F.lit(16.0), 1.8 * (F.col("y1") - F.col("y0")))).cast("int"))
    return wide.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n"), F.sum("wide").alias("wide")).where("n >= 3 AND wide >= 2").select(*LINE, F.lit(True).alias("gapped"))


def typed_lines(lines: DataFrame, spans: DataFrame, page_height: float = HEIGHT) -> DataFrame:
    """Lines with words and an area, their type and the number of their block on the page."""
    real = lines.where((T.trim(F.col("text")) != "") & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    middle = real.groupBy(*PAGE).agg(upper_median(F.col("y1") - F.col("y0")).alias("mh"))
    page = Window.partitionBy(*PAGE).orderBy("line_index")
    edge = F.when(F.col("y0") / page_height < 0.08, "header").when(F.col("y1") / page_height > 0.92, "footer")
    rows = real.join(middle, PAGE).join(wide_gaps(spans), LINE, "left").withColumn("edge", edge)
    earlier = F.max(F.col("edge").isNull().cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1))
    first = (F.coalesce(earlier, F.lit(0)) == 0) & (F.octet_length("text") <= 120) & (F.col("y1") - F.col("y0") >= 1.05 * F.col("mh"))
    kind = F.coalesce("edge", F.when(F.coalesce("gapped", F.lit(False)) | T.dot_leader(F.col("text")), "table").when(T.list_marker(F.col("text")), "list").when(first, "title").otherwise("text"))
    rows = rows.withColumn("type", kind)
    before = {c: F.lag(c).over(page) for c in ("type", "x0", "y0", "y1")}
    h = F.greatest(F.lit(1.0), before["y1"] - before["y0"])
    step = F.col("y0") - before["y1"]
    joins = (F.col("type") == before["type"]) & ~F.col("type").isin("title", "header", "footer") & step.between(F.lit(0.0), 1.8 * h) & (F.abs(F.col("x0") - before["x0"]) <= 4 * h)
    rows = rows.withColumn("fresh", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("block_index", (F.sum("fresh").over(page) - 1).cast("int")).drop("edge", "gapped", "fresh", "mh")


def blocks(typed: DataFrame) -> DataFrame:
    """One row a block: type, box, text (lines joined by a line feed), number of lines and confidence of the rule."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), "\n")
    source = F.when(F.count_distinct("source") > 1, "mixed").otherwise(F.min("source"))
    out = typed.groupBy(*PAGE, "block_index").agg(F.min("type").alias("type"), F.count(F.lit(1)).alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text"), source.alias("source"))
    sure = F.when(F.col("type") == "title", 0.70).when(F.col("type").isin("header", "footer"), 0.65).when(F.col("type").isin("table", "list"), 0.60).when(F.col("n_lines") > 1, 0.75).otherwise(0.68)
    return out.withColumn("confidence", sure)


def page_figures(pages: DataFrame, found: DataFrame) -> DataFrame:
    """A page without a block is one figure: (doc_id, page_index) of these pages."""
    return pages.join(found.select(*PAGE).distinct(), PAGE, "left_anti")


def assign_lines(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each line's block: most covered (at least half, or its centre inside), then smallest area, then first."""
    a = lines.select(*LINE, *[F.col(c).alias("l_" + c) for c in ("x0", "y0", "x1", "y1")])
    b = boxes.select(*PAGE, "block_index", *[F.col(c).alias("b_" + c) for c in ("x0", "y0", "x1", "y1")])
    near = a.join(b, PAGE).withColumn("coverage", G.coverage("l_", "b_")).where((F.col("coverage") >= 0.5) | G.center_inside("l_", "b_"))
    best = Window.partitionBy(*LINE).orderBy(F.col("coverage").desc(), G.area("b_"), "block_index")
    return near.withColumn("r", F.row_number().over(best)).where("r = 1").select(*LINE, "block_index", "coverage")


def caption_targets(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """The nearest figure or table of each caption block within a quarter of the page's diagonal."""
    sides = ("x0", "y0", "x1", "y1")
    c = boxes.where("is_caption").select(*PAGE, F.col("block_index").alias("caption"), *[F.col(s).alias("c_" + s) for s in sides])
    t = boxes.where(F.col("type").isin("figure", "table")).select(*PAGE, F.col("block_index").alias("target"), *[F.col(s).alias("t_" + s) for s in sides])
    near = c.join(t, PAGE).where("caption <> target").withColumn("distance", G.distance("c_", "t_")).where(F.col("distance") <= 0.25 * (width**2 + height**2) ** 0.5)
    return near.withColumn("r", F.row_number().over(Window.partitionBy(*PAGE, "caption").orderBy("distance", "target"))).where("r = 1").drop("r")


def edge_furniture(found: DataFrame, page_height: float = HEIGHT) -> DataFrame:
    """Text, list and unknown blocks whose centre is in the outer twentieth become header or footer of confidence 0.5 at most."""
    y = (F.col("y0") + F.col("y1")) / 2 / page_height
    new = F.when(F.col("type").isin("unknown", "text", "list"), F.when(y <= 0.05, "header").when(y >= 0.95, "footer"))
    return found.withColumn("confidence", F.when(new.isNotNull(), F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence"))).withColumn("type", F.coalesce(new, "type"))
