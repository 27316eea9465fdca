"""Glyphs to lines, the quality gate of native text, OCR words to lines, OCR merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.synthetic import PAGE
from .groups import map_groups


SIDES = ("x0", "y0", "x1", "y1")
PART_BYTES = 1 << 20  # of text that is taken apart at once, or one row


def breaks(p: dict[str, np.ndarray], q: dict[str, np.ndarray]) -> np.ndarray:
    """Whether each glyph of q starts a new line after that of p."""
    hp, hq = p["y1"] - p["y0"], q["y1"] - q["y0"]
    tall, low = np.maximum(hp, hq), np.minimum(hp, hq)
    with np.errstate(divide="ignore", invalid="ignore"):
        overlap = np.maximum(0.0, np.minimum(p["y1"], q["y1"]) - np.maximum(p["y0"], q["y0"])) / low
        apart = np.abs((p["y0"] + p["y1"] - q["y0"] - q["y1"]) / 2)
        jump = (overlap < 0.20) & (apart > 0.80 * tall) | (overlap >= 0.50) & ((q["x0"] - p["x1"] > 6 * tall) | (p["x0"] - q["x1"] > 2 * tall))
        return jump & ~((hp <= 0) | (hq <= 0))


def token_glyphs(tokens: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Tokens (kind, text and a box each) as columns of glyphs; a token without text has no ink."""
    text = tokens.column("text")
    kind, filled = tokens.column("kind"), text.fill_null("").cast(pa.large_string())
    brk = pc.equal(kind, "line_break").fill_null(False).to_numpy(zero_copy_only=False)
    blank = pc.is_in(text, pa.array([" ", "\t", None], text.type)).to_numpy(zero_copy_only=False)
    glyph = pc.equal(kind, "glyph").fill_null(False).to_numpy(zero_copy_only=False)
    off = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    row = np.flatnonzero(~brk)
    side = {s: np.asarray(tokens.column(s).to_numpy(zero_copy_only=False), np.float64)[row] for s in SIDES}
    return {"row": row, "run": np.cumsum(brk)[row], "ink": (glyph & ~blank)[row], "data": np.frombuffer(filled.buffers()[2] or b"", np.uint8), "start": off[:-1][row], "end": off[1:][row], **side}


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """Whether each row but the first is on another page than the row before it."""
    out = np.zeros(max(0, batch.num_rows - 1), bool)
    for name in PAGE:
        c = batch.column(name)
        nulls = c.is_null().to_numpy(zero_copy_only=False)
        out |= pc.not_equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False) | (nulls[1:] != nulls[:-1])
    return out


def _lines(batch: pa.RecordBatch, glyphs: dict[str, np.ndarray], page: np.ndarray, first: int) -> tuple[pa.RecordBatch, int]:
    """The lines of a batch's glyphs, and how many the last page has. page: of each row, from 0; page 0 has ``first`` lines
    from before."""
    last = int(page[-1])
    ink = np.flatnonzero(glyphs["ink"])
    if not len(ink):
        return _made(batch, ink, [], {s: np.empty(0) for s in SIDES}, ink), first if last == 0 else 0
    box = {s: glyphs[s][ink] for s in SIDES}
    on, run = page[glyphs["row"]], glyphs["run"]
    part = np.append(0, np.cumsum((run[1:] != run[:-1]) | (on[1:] != on[:-1])))  # runs of a page, in sequence
    fresh = np.ones(len(ink), bool)
    fresh[1:] = (np.diff(part[ink]) != 0) | breaks({s: v[:-1] for s, v in box.items()}, {s: v[1:] for s, v in box.items()})
    begin = np.flatnonzero(fresh)
    start = ink[begin]  # a line reaches to the next one or to the end of its run
    end = np.minimum(np.append(start[1:], len(part)), np.searchsorted(part, part[start], "right"))
    text = [glyphs["data"][a:b].tobytes().decode() for a, b in zip(glyphs["start"][start].tolist(), glyphs["end"][end - 1].tolist())]
    sides = {s: (np.fmin if s in ("x0", "y0") else np.fmax).reduceat(box[s], begin) for s in SIDES}
    at = on[start]
    before = np.bincount(at, minlength=last + 1)
    index = np.arange(len(at)) - (np.cumsum(before) - before)[at] + np.where(at == 0, first, 0)
    return _made(batch, glyphs["row"][start], text, sides, index), int(before[last]) + (first if last == 0 else 0)


def _made(batch: pa.RecordBatch, row: np.ndarray, text: list[str], sides: dict[str, np.ndarray], index: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row, pa.int64())
    columns = [*[batch.column(c).take(at) for c in PAGE], pa.array(text, pa.string()), *[pa.array(sides[s], pa.float64(), from_pandas=True) for s in SIDES], pa.array(index, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [*PAGE, "text", *SIDES, "line_index"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that end with a line break or with the last row."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ends = pc.equal(batch.column("kind"), "line_break").fill_null(False).to_numpy(zero_copy_only=False).nonzero()[0]
        if len(ends):
            yield pa.Table.from_batches([*held, batch.slice(0, ends[-1] + 1)]).combine_chunks().to_batches()[0]
            held, batch = [], batch.slice(ends[-1] + 1)
        held += [batch] if batch.num_rows else []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some PART_BYTES of text."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(size // PART_BYTES)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def glyphs_to_lines(tokens: DataFrame, order: str = "token_index", glyphs: Callable[[pa.RecordBatch], dict[str, np.ndarray]] | None = None) -> DataFrame:
    """Lines of glyph tokens: a line break or a geometric jump ends a line, leading blanks are skipped, inner and
    trailing blanks are text but do not widen the box.

    A row is a token, or with ``glyphs`` all tokens up to a line break, packed: that takes a batch of rows apart into
    columns with a place for each token but line breaks, so that no row a character is dealt or sorted (row and run: its
    row and the number of breaks before it; start and end: its text in the bytes ``data``, where a run's texts follow each
    other; ink; x0, y0, x1, y1). Pages are read in sequence and need not fit in memory.
    """
    packed, take = glyphs is not None, glyphs or token_glyphs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        for batch in _parts(batches) if packed else _whole(batches):
            if not batch.num_rows:
                continue
            ends = [tuple(batch.column(c)[i].as_py() for c in PAGE) for i in (0, -1)]
            page = np.append(0, np.cumsum(_changes(batch)))
            made, n = _lines(batch, take(batch), page, n if key == ends[0] else 0)
            key = ends[1]
            yield made

    kind = {f.name: f.dataType.simpleString() for f in tokens.schema}
    schema = ", ".join([*(f"{c} {kind[c]}" for c in PAGE), "text string", *(f"{s} double" for s in SIDES), "line_index int"])
    return tokens.repartition(*PAGE).sortWithinPartitions(*PAGE, order).mapInArrow(run, schema)


def vertical_coverage(lines: DataFrame, height: float) -> DataFrame:
    """(doc_id, page_index, coverage): the share of the page's height under the union of the lines' intervals."""
    page = Window.partitionBy(*PAGE).orderBy("a", "b")
    cut = lines.select(*PAGE, F.least(F.greatest("y0", F.lit(0.0)), F.lit(float(height))).alias("a"), F.least(F.greatest("y1", F.lit(0.0)), F.lit(float(height))).alias("b")).where("b > a")
    reach = F.max("b").over(page.rowsBetween(Window.unboundedPreceding, -1))
    isle = cut.withColumn("fresh", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("isle", F.sum("fresh").over(page))
    return isle.groupBy(*PAGE, "isle").agg((F.max("b") - F.min("a")).alias("n")).groupBy(*PAGE).agg((F.sum("n") / height).alias("coverage"))


def text_quality(pages: DataFrame, lines: DataFrame, height: float, controls: DataFrame | None = None) -> DataFrame:
    """Per page: bytes, suspicious share, control damage, coverage and action (use_ocr, merge_ocr or use_native).

    controls: doc_id, page_index, decoded, code, n: how often each control character was decoded."""
    lot = lines.groupBy(*PAGE).agg(
        F.sum(F.octet_length("text")).alias("bytes"),
        F.sum(F.regexp_count("text", F.lit(r"[\x00-\x08\x0E-\x1F\x7F]")) + 3 * F.regexp_count("text", F.lit("�"))).alias("suspicious"),
    )
    out = pages.select(*PAGE).join(lot, PAGE, "left").join(vertical_coverage(lines, height), PAGE, "left").fillna(0, ["bytes", "suspicious", "coverage"])
    if controls is not None:
        bad = controls.where(~F.col("code").isin(2, 9, 10, 13) & (F.col("n") > 0)).groupBy(*PAGE).agg(F.sum("n").alias("n"), F.count_distinct("code").alias("kinds"), F.max("decoded").alias("decoded"))
        ratio = F.col("n") / F.greatest(F.col("decoded"), F.lit(1))
        bad = bad.select(*PAGE, ((F.col("n") >= 8) & ((ratio >= 0.20) | (ratio >= 0.05) & (F.col("kinds") >= 4))).alias("damaged"))
        out = out.join(bad, PAGE, "left").fillna(False, ["damaged"])
    else:
        out = out.withColumn("damaged", F.lit(False))
    action = F.when((F.col("bytes") == 0) | F.col("damaged") | (F.col("suspicious") > 0.02 * F.col("bytes")), "use_ocr").when((F.col("bytes") < 256) & (F.col("coverage") < 0.12), "merge_ocr").otherwise("use_native")
    return out.withColumn("action", action)


def merge_ocr(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Native lines and those OCR lines that overlap no kept line by half of the smaller; sorted by (y0, x0).

    OCR lines are taken in order and see those before, so a page is one group (a page's lines are few)."""
    columns = [*PAGE, "line_index", "text", "x0", "y0", "x1", "y1", "source"]

    def page(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in sorted(rows, key=lambda r: (r["is_ocr"], r["line_index"])):
            if r["is_ocr"]:
                if not (r["text"] or "").strip():
                    continue
                small = lambda k: min((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]), (k["x1"] - k["x0"]) * (k["y1"] - k["y0"]))
                both = lambda k: max(0, min(r["x1"], k["x1"]) - max(r["x0"], k["x0"])) * max(0, min(r["y1"], k["y1"]) - max(r["y0"], k["y0"]))
                if any(small(k) > 0 and both(k) / small(k) >= 0.5 for k in kept):
                    continue
            kept.append(r)
        kept.sort(key=lambda r: (r["y0"], r["x0"]))
        return [{**r, "line_index": i} for i, r in enumerate(kept)]

    both = native.select(*columns).withColumn("is_ocr", F.lit(0)).unionByName(ocr.select(*columns).withColumn("is_ocr", F.lit(1)))
    return map_groups(both, PAGE, page).drop("is_ocr")


def words_to_lines(words: DataFrame) -> DataFrame:
    """OCR words (block, par, line, word, text, box, conf 0..100) to lines with mean confidence."""
    ok = words.where((T.trim(F.col("text")) != "") & (F.col("conf").cast("int") >= 0) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ")
    return ok.groupBy(*PAGE, "block", "par", "line").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg(F.least(F.col("conf") / 100, F.lit(1.0))).alias("confidence"))
