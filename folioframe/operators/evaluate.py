"""Evaluation: error rates, box matching, detection scores, order scores, gates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .groups import map_groups


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.when(a > 0, 1.0).otherwise(0.0))


def error_rates(pairs: DataFrame, key: str) -> DataFrame:
    """key, distances and sizes in characters and words, cer and wer. pairs: key, reference, prediction (null: missing)."""
    text = lambda c: T.simple_normal(F.coalesce(F.col(c), F.lit("")))
    p = pairs.select(key, text("reference").alias("r"), text("prediction").alias("p"), F.col("prediction").isNull().alias("missing"))
    words = lambda c: F.when(F.col(c) == "", 0).otherwise(F.regexp_count(c, F.lit(" ")) + 1)
    out = p.select(key, "missing", F.levenshtein("r", "p").alias("char_errors"), F.length("r").alias("chars"), T.word_distance(F.col("r"), F.col("p")).alias("word_errors"), words("r").alias("words"))
    return out.withColumns({"cer": ratio(F.col("char_errors"), F.col("chars")), "wer": ratio(F.col("word_errors"), F.col("words"))})


def corpus_rates(rates: DataFrame) -> DataFrame:
    s = rates.agg(F.sum("char_errors").alias("ce"), F.sum("chars").alias("c"), F.sum("word_errors").alias("we"), F.sum("words").alias("w"), F.sum(F.col("missing").cast("int")).alias("missing"))
    return s.select(ratio(F.col("ce"), F.col("c")).alias("cer"), ratio(F.col("we"), F.col("w")).alias("wer"), "missing")


def page_totals(pages: DataFrame) -> DataFrame:
    """One row: pages, ok_rate, text_found_rate, cer, detection_recall and crop_cer (0 where nothing can be divided).

    pages: ok, pred_chars, gt_chars, edit_distance, gt_words, found_words, crop_chars, crop_distance."""
    share = lambda a, b: F.coalesce(F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)), F.lit(0.0))
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return pages.agg(
        F.count(F.lit(1)).alias("pages"), rate(F.col("ok")).alias("ok_rate"), rate(F.col("pred_chars") > 0).alias("text_found_rate"), share("edit_distance", "gt_chars").alias("cer"),
        share("found_words", "gt_words").alias("detection_recall"), share("crop_distance", "crop_chars").alias("crop_cer"),
    )


def character_excess(pairs: DataFrame, key: str) -> DataFrame:
    """key, excess: characters of the prediction beyond their number in the reference."""
    chars = lambda c, n: pairs.select(key, F.explode(F.split(c, "")).alias("ch")).where("ch <> ''").groupBy(key, "ch").agg(F.count(F.lit(1)).alias(n))
    both = chars("prediction", "np").join(chars("reference", "nr"), [key, "ch"], "full").fillna(0, ["np", "nr"])
    return both.groupBy(key).agg(F.sum(F.greatest(F.col("np") - F.col("nr"), F.lit(0))).alias("excess"))


def match_boxes(references: DataFrame, predictions: DataFrame, key: list[str], threshold: float = 0.5) -> DataFrame:
    """A largest one-to-one matching of boxes with IoU at least ``threshold`` in each group: (key, ref_id, pred_id, iou).

    Both sides: key, box_id, x0..y1. Augmenting paths try partners by falling IoU, then by id."""
    cols = ["box_id", "x0", "y0", "x1", "y1"]
    rename = lambda df, p: df.select(*key, *[F.col(c).alias(p + c) for c in cols])
    near = rename(references, "r_").join(rename(predictions, "p_"), key).withColumn("iou", G.iou("r_", "p_")).where(F.col("iou") >= threshold).select(*key, F.col("r_box_id").alias("ref_id"), F.col("p_box_id").alias("pred_id"), "iou")

    def group(rows: list[dict]) -> list[dict]:
        partners: dict = {}
        for i, r in sorted(enumerate(rows), key=lambda x: (x[1]["ref_id"], -x[1]["iou"], x[1]["pred_id"])):
            partners.setdefault(r["ref_id"], []).append((r["pred_id"], i))
        owner: dict = {}
        for start in partners:
            # An augmenting path by depth-first search with an explicit stack.
            stack, seen, via = [(start, iter(partners[start]))], set(), []
            while stack:
                node, options = stack[-1]
                for pred, row in options:
                    if pred in seen:
                        continue
                    seen.add(pred)
                    via.append((node, pred, row))
                    if pred not in owner:
                        for n, p, i in via:
                            owner[p] = (n, i)
                        stack = []
                    else:
                        nxt = owner[pred][0]
                        stack.append((nxt, iter(partners[nxt])))
                    break
                else:
                    stack.pop()
                    if via and stack:
                        via.pop()
        return [rows[i] for _, i in owner.values()]

    return map_groups(near, key, group)


def detection_scores(references: DataFrame, predictions: DataFrame, matches: DataFrame, label: str = "label") -> DataFrame:
    """Per label: tp, fp, fn, precision, recall, f1 and mean IoU of matches (0 where nothing can be divided)."""
    n = lambda df, name: df.groupBy(label).agg(F.count(F.lit(1)).alias(name))
    hits = matches.groupBy(label).agg(F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("mean_iou"))
    all_ = n(references, "refs").join(n(predictions, "preds"), label, "full").join(hits, label, "left").fillna(0)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = all_.withColumns({"fp": F.col("preds") - F.col("tp"), "fn": F.col("refs") - F.col("tp"), "precision": safe(F.col("tp"), F.col("preds")), "recall": safe(F.col("tp"), F.col("refs"))})
    return out.withColumn("f1", safe(2 * F.col("tp"), F.col("preds") + F.col("refs")))


def order_score(placed: DataFrame, key: str) -> DataFrame:
    """key, pairs, correct, score over pairs of anchors (rank, position) in reference order; null positions are not comparable."""
    a = placed.where("position IS NOT NULL")
    b = a.select(key, F.col("rank").alias("rank2"), F.col("position").alias("position2"))
    pairs = a.join(b, key).where("rank < rank2")
    out = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("position") < F.col("position2")).cast("int")).alias("correct"))
    return out.withColumn("score", F.col("correct") / F.col("pairs"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metric, value, operator, bound, status: failed, incomplete (no value) or passed."""
    both = thresholds.join(metrics, "metric", "left")
    ok = F.when(F.col("operator") == "gte", F.col("value") >= F.col("bound")).when(F.col("operator") == "lte", F.col("value") <= F.col("bound")).when(F.col("operator") == "eq", F.col("value") == F.col("bound"))
    return both.withColumn("status", F.when(F.col("value").isNull(), "incomplete").when(ok, "passed").otherwise("failed"))
