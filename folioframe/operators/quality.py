"""Evaluation of tables and pipelines, quality reports, and checks of corpora and manifests."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import geometry as G
from ..functions import text as T
from .evaluate import match_boxes, ratio

SIDES = ["x0", "y0", "x1", "y1"]
LAYERS = ("backend", "pipeline", "product")
#: The comparison that each direction of a metric asks for (fixed values).
DIRECTIONS = {"higher_is_better": "gte", "lower_is_better": "lte", "target": "eq"}


def cell_text_scores(references: DataFrame, predictions: DataFrame, key: list[str], threshold: float = 0.5, ignore_case: bool = False) -> DataFrame:
    """Per group: cells, matches, exact texts, characters, edit distance, coverage, exact rate and cer. An unmatched
    reference is compared with an empty text. Both sides: key, box_id, box, text."""
    fold = lambda c: T.simple_normal(c) if ignore_case else T.trim(F.regexp_replace(c, f"{T.WS}+", " "))
    pairs = match_boxes(references, predictions, key, threshold).select(*key, F.col("ref_id").alias("box_id"), "pred_id")
    said = predictions.select(*key, F.col("box_id").alias("pred_id"), F.col("text").alias("got"))
    got = references.join(pairs, [*key, "box_id"], "left").join(said, [*key, "pred_id"], "left")
    got = got.select(*key, "pred_id", fold(F.coalesce("text", F.lit(""))).alias("r"), fold(F.coalesce("got", F.lit(""))).alias("p"))
    own = got.groupBy(*key).agg(
        F.count(F.lit(1)).alias("reference_cells"), F.count("pred_id").alias("matched_cells"), F.sum((F.col("pred_id").isNotNull() & (F.col("r") == F.col("p"))).cast("int")).alias("exact_text_cells"),
        F.sum(F.length("r")).alias("reference_characters"), F.sum(F.levenshtein("r", "p")).alias("character_edit_distance"),
    )
    out = own.join(predictions.groupBy(*key).agg(F.count(F.lit(1)).alias("predicted_cells")), key, "left").fillna(0, ["predicted_cells"])
    n = F.col("reference_cells")
    return out.withColumns({"cell_coverage": F.col("matched_cells") / n, "exact_text_cell_rate": F.col("exact_text_cells") / n, "table_text_cer": ratio(F.col("character_edit_distance"), F.col("reference_characters"))})


def _longest(text: str, block: str) -> tuple[int, int]:
    """Characters in matching runs, and where the longest of them begins in the block."""
    runs = SequenceMatcher(None, text, block, autojunk=False).get_matching_blocks()
    return sum(r.size for r in runs), max(runs, key=lambda r: r.size).b


@F.pandas_udf(StructType([StructField("matched", IntegerType()), StructField("position", DoubleType())]))
def best_alignment(anchor: pd.Series, blocks: pd.Series) -> pd.DataFrame:
    """Characters of the anchor that the best block matches (the first of equals) and where its longest match begins:
    the block's number plus the share of the block before it."""

    def one(text: str, held: list[str]) -> tuple[int, float]:
        # No block matches more characters than the two have in common, whatever their order: the most promising
        # blocks come first, and those that cannot win are not compared.
        own = Counter(text)
        most = sorted((-(own & Counter(block)).total(), i) for i, block in enumerate(held))
        best, first, at = 0, len(held), 0.0
        for bound, i in most:
            if (-bound, -i) < (best, -first) or not bound:
                break
            block = held[i]
            n, start = (len(text), block.find(text)) if text in block else _longest(text, block)
            if (n, -i) > (best, -first):
                best, first, at = n, i, i + start / max(len(block), 1)
        return best, at

    return pd.DataFrame([one(a or "", [b or "" for b in held] if held is not None else []) for a, held in zip(anchor, blocks)], columns=["matched", "position"])


def anchor_alignments(anchors: DataFrame, blocks: DataFrame, key: str, threshold: float = 0.8) -> DataFrame:
    """anchors (key, rank, text) with the characters aligned and, where they are at least ``threshold`` of the text,
    position for ``order_score``. blocks: key, position, text. A missing document aligns with nothing."""
    clean = T.nfkc
    held = blocks.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", clean(F.col("text")).alias("t")))), lambda x: x["t"]).alias("blocks"))
    both = anchors.withColumn("t", clean(F.col("text"))).join(held, key, "left").withColumn("a", best_alignment("t", "blocks"))
    size = F.length("t")
    return both.select(key, "rank", size.alias("characters"), F.col("a.matched").alias("aligned"), F.when((size > 0) & (F.col("a.matched") >= threshold * size), F.col("a.position")).alias("position"))


def word_recall(words: DataFrame, regions: DataFrame, key: list[str], threshold: float = 0.5) -> DataFrame:
    """Per group: words, words of which a region covers ``threshold``, and recall. words: key, word_id and box."""
    rename = lambda df, p: [F.col(s).alias(p + s) for s in SIDES]
    w = words.select(*key, "word_id", *rename(words, "w_"))
    seen = w.join(regions.select(*key, *rename(regions, "r_")), key).where(G.coverage("w_", "r_") >= threshold).select(*key, "word_id").distinct()
    all_ = words.groupBy(*key).agg(F.count(F.lit(1)).alias("words"))
    out = all_.join(seen.groupBy(*key).agg(F.count(F.lit(1)).alias("detected")), key, "left").fillna(0, ["detected"])
    return out.withColumn("recall", F.col("detected") / F.col("words"))


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(1e-12 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))


def passes(value: Column, operator: Column, bound: Column) -> Column:
    return F.when(operator == "gte", value >= bound).when(operator == "lte", value <= bound).when(operator == "eq", _near(value, bound))


def report_status(metrics: DataFrame, required: DataFrame) -> DataFrame:
    """Per report: thresholds evaluated and failed, missing layers, and status: failed before incomplete (a layer is
    missing or nothing was evaluated) before passed. metrics: report, layer, name, value, operator, bound (null: no
    threshold); required: layer (a short list of names)."""
    held = metrics.withColumn("ok", passes(F.col("value"), F.col("operator"), F.col("bound")))
    per = held.groupBy("report").agg(F.count("operator").alias("evaluated"), F.sum((~F.coalesce("ok", F.col("operator").isNull())).cast("int")).alias("failed"), F.collect_set("layer").alias("layers"))
    # ``required`` names layers of the report format: one row.
    want = per.join(F.broadcast(required.agg(F.array_sort(F.collect_set("layer")).alias("want"))))
    out = want.withColumn("missing", F.array_join(F.filter("want", lambda x: ~F.array_contains("layers", x)), ","))
    status = F.when(F.col("failed") > 0, "failed").when((F.col("missing") != "") | (F.col("evaluated") == 0), "incomplete").otherwise("passed")
    return out.select("report", "evaluated", "failed", "missing", status.alias("status"))


def report_violations(metrics: DataFrame) -> DataFrame:
    """(report, layer, name, rule) of metrics that contradict themselves. metrics: report, layer, name, value,
    direction, operator, numerator, denominator."""
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv]), F.col("direction"))
    top, bottom = F.col("numerator"), F.col("denominator")
    share = F.when(bottom > 0, top / bottom).otherwise(0.0)
    rules = {
        "layer_known": ~F.col("layer").isin(*LAYERS), "value_finite": F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), "operator_fits_direction": F.col("operator").isNotNull() & ~wanted.eqNullSafe(F.col("operator")),
        "ratio_complete": top.isNull() != bottom.isNull(), "denominator_not_negative": bottom < 0, "zero_denominator": (bottom == 0) & (top != 0), "value_is_ratio": (bottom >= 0) & top.isNotNull() & ~_near(F.col("value"), share),
        "name_unique": F.count(F.lit(1)).over(Window.partitionBy("report", "layer", "name")) > 1,
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]))
    return metrics.withColumn("rules", broken).select("report", "layer", "name", F.explode("rules").alias("rule")).distinct()


def corpus_violations(samples: DataFrame, objects: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, rule, n): boxes beyond the image by over a pixel, cells beyond their grid, slots held twice, slots not held.

    samples: id, width, height, n_rows, n_columns; objects: id, box; cells: id, row_index, column_index, row_span, column_span."""
    say = lambda df, rule, n: df.groupBy("id").agg(n.cast("long").alias("n")).select("id", F.lit(rule).alias("rule"), "n").where("n > 0")
    boxed = objects.join(samples, "id").withColumn("bad", ~((F.col("x0") >= 0) & (F.col("x0") <= F.col("x1")) & (F.col("x1") <= F.col("width") + 1) & (F.col("y0") >= 0) & (F.col("y0") <= F.col("y1")) & (F.col("y1") <= F.col("height") + 1)))
    placed = cells.join(samples, "id").withColumn("bad", (F.col("row_index") < 0) | (F.col("column_index") < 0) | (F.col("row_span") < 1) | (F.col("column_span") < 1) | (F.col("row_index") + F.col("row_span") > F.col("n_rows")) | (F.col("column_index") + F.col("column_span") > F.col("n_columns")))
    span = lambda c, n: F.explode(F.sequence(F.col(c), F.col(c) + F.col(n) - 1))
    slots = placed.where("NOT bad").select("id", span("row_index", "row_span").alias("r"), "column_index", "column_span").select("id", "r", span("column_index", "column_span").alias("c"))
    held = slots.groupBy("id", "r", "c").agg((F.count(F.lit(1)) - 1).alias("again"))
    full = samples.join(held.groupBy("id").agg(F.count(F.lit(1)).alias("held")), "id", "left").where("n_rows > 0").withColumn("open", F.col("n_rows") * F.col("n_columns") - F.coalesce("held", F.lit(0)))
    parts = [say(boxed, "box_inside_image", F.sum(F.col("bad").cast("int"))), say(placed, "cell_inside_grid", F.sum(F.col("bad").cast("int"))), say(held, "slots_held_once", F.sum("again")), say(full, "grid_covered", F.sum("open"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def manifest_violations(files: DataFrame) -> DataFrame:
    """(manifest, id, rule) of the entries of model manifests: manifest, id, role, path, sha256, url, license_url."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    same = lambda c: F.count(F.lit(1)).over(Window.partitionBy("manifest", c)) > 1
    rules = {
        "id_present": text("id") == "", "role_present": text("role") == "", "id_unique": same("id"), "path_unique": same("path"), "sha256_hex": ~text("sha256").rlike(r"^[0-9a-f]{64}\z"),
        "path_relative": text("path").rlike(r"^/|(^|/)\.\.?(/|\z)|//|/\z") | (text("path") == ""), "source_https": ~text("url").startswith("https://"), "license_https": ~text("license_url").startswith("https://"),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return files.withColumn("rules", broken).select("manifest", "id", F.explode("rules").alias("rule"))


def reference_cells(rows: DataFrame, columns: DataFrame, spanning: DataFrame, headers: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, problems) of annotated tables (table_id and a box; slots: table_id, row_index, column_index, text).

    Spanning boxes hold the rows and columns whose centre they contain (a pixel of tolerance) and the texts of those
    slots, spaced, in row order, empty ones left out; one with ``projected`` is a header. Every other row x column is
    a cell; its row decides whether it is a header: one whose box a header box covers by more than half. problems
    (table_id, rule) are ``grids_differ`` (the slots say another number of rows or columns), ``span_without_slot``
    and ``spans_overlap``; tables with a problem give no cells.
    """
    box = ("x0", "y0", "x1", "y1")
    named = lambda df, p: [F.col(c).alias(p + c) for c in box if c in df.columns]
    tops = headers.select("table_id", *named(headers, "h_"))

    def headed(df: DataFrame, p: str, number: str, order: list[str], *more: str) -> DataFrame:
        numbered = df.select("table_id", *more, *named(df, p), (F.row_number().over(Window.partitionBy("table_id").orderBy(*order)) - 1).alias(number))
        share = F.max(F.coalesce(G.coverage(p, "h_"), F.lit(0.0))) > 0.5
        return numbered.join(tops, "table_id", "left").groupBy(*numbered.columns).agg(share.alias(p + "header"))

    table = Window.partitionBy("table_id")
    count = lambda df, n: df.withColumn(n, F.count(F.lit(1)).over(table))
    r, c = count(headed(rows, "r_", "row_index", ["y0", "x0"]), "n_r"), count(headed(columns, "c_", "column_index", ["x0", "y0"]).drop("c_header"), "n_c")
    s = headed(spanning, "s_", "span_id", ["y0", "x0", "x1", "y1"], "projected")
    holds = (((F.col("r_y0") + F.col("r_y1")) / 2).between(F.col("s_y0") - 1, F.col("s_y1") + 1)) & (((F.col("c_x0") + F.col("c_x1")) / 2).between(F.col("s_x0") - 1, F.col("s_x1") + 1))
    slot = ["table_id", "row_index", "column_index"]
    texts = slots.select(*slot, F.when(F.col("text") != "", F.col("text")).alias("text"))
    said = texts.groupBy("table_id").agg((F.max("row_index") + 1).alias("m_r"), (F.max("column_index") + 1).alias("m_c"))
    asked = s.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_s"))
    # The slots of each table with the spanning boxes that hold them; a table is small, its parts meet by its id.
    cross = r.join(c, "table_id")
    by_span = s.withColumnRenamed("table_id", "s_table")
    marked = cross.join(by_span, (F.col("table_id") == F.col("s_table")) & holds, "left").drop("s_table")
    marked = marked.join(said, "table_id", "left").join(asked, "table_id", "left").withColumn("held", F.count("span_id").over(Window.partitionBy(*slot)))
    found = F.size(F.collect_set("span_id").over(table))
    marked = marked.withColumns({"spans_overlap": F.max("held").over(table) > 1, "span_without_slot": found < F.coalesce("n_s", F.lit(0))})

    whole = marked.where("NOT spans_overlap AND NOT span_without_slot AND n_r = m_r AND n_c = m_c").join(texts, slot, "left")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("row_index", "column_index", "text")))), lambda x: x["text"]), " ")
    plain = F.col("span_id").isNull()
    own = {n: F.when(plain, F.col(n)) for n in ("row_index", "column_index")}  # a slot without a span is a cell
    sides = {"x0": F.greatest("r_x0", "c_x0"), "y0": F.greatest("r_y0", "c_y0"), "x1": F.least("r_x1", "c_x1"), "y1": F.least("r_y1", "c_y1")}
    first = [F.first(F.when(plain, sides[b]).otherwise(F.col("s_" + b))).alias(b) for b in box]
    header = F.first(F.when(plain, F.col("r_header")).otherwise(F.col("projected") | F.col("s_header"))).alias("is_header")
    cells = whole.groupBy("table_id", "span_id", own["row_index"].alias("own_row"), own["column_index"].alias("own_column")).agg(F.min("row_index").alias("row_index"), F.min("column_index").alias("column_index"), F.count_distinct("row_index").alias("row_span"), F.count_distinct("column_index").alias("column_span"), header, *first, ordered.alias("text")).drop("span_id", "own_row", "own_column")

    # Tables that lack rows, columns or slots altogether have no slot above.
    sizes = r.groupBy("table_id").agg(F.first("n_r").alias("n_r")).join(c.groupBy("table_id").agg(F.first("n_c").alias("n_c")), "table_id", "full").join(said, "table_id", "full").na.fill(0)
    lost = marked.groupBy("table_id").agg(F.first("span_without_slot").alias("lost")).join(asked, "table_id", "right").where("coalesce(lost, true)")
    rule = lambda df, name: df.select("table_id", F.lit(name).alias("rule")).distinct()
    problems = rule(sizes.where("n_r <> m_r OR n_c <> m_c"), "grids_differ").unionByName(rule(lost, "span_without_slot")).unionByName(rule(marked.where("spans_overlap"), "spans_overlap"))
    return cells, problems
