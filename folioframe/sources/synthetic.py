"""Pages, lines, spans and tokens with geometry, made of plain documents by fixed rules (12 lines a page, 1000 x 1400)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_LINES, WIDTH, HEIGHT = 12, 1000, 1400
PAGE = ["doc_id", "page_index"]


def lines(documents: DataFrame) -> DataFrame:
    split = documents.select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ln", "t"))
    i, doc = F.col("line_index"), F.col("doc_id")
    made = split.withColumns({"page_index": F.expr("ln div 12").cast("int"), "line_index": F.col("ln") % 12})
    text = F.when((doc % 5 == 0) & (i == 0), F.concat("lang", F.lit(" report "), "doc_id")).when((doc % 5 == 0) & (i == 11), F.concat(F.lit("Page "), (F.col("page_index") + 1).cast("string")))
    made = made.withColumn("text", text.when((doc % 7 == 2) & (i == 5), F.concat(F.lit("- "), "t")).otherwise(F.col("t")))
    made = made.withColumns({"h": 40 + (doc + i) % 9, "y0": (20 + 116 * i).cast("double"), "x0": F.when(doc % 4 == 0, 60 + 440 * (i % 2)).otherwise(60).cast("double")})
    wide = F.least(F.when(doc % 4 == 0, 400).otherwise(880), 8 * F.octet_length("text"))
    return made.select(
        "doc_id", "page_index", "line_index", "ln", "text", "x0", "y0", (F.col("x0") + wide).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"),
        F.when(doc % 10 == 3, "ocr").otherwise("pdf_text_layer").alias("source"), (1 - (i % 10) / 100).alias("confidence"),
    )


def spans(line_rows: DataFrame) -> DataFrame:
    """Words with boxes; lines with ln % 7 = 3 have wide gaps, as tables have."""
    words = line_rows.select("doc_id", "page_index", "line_index", "ln", F.col("x0").alias("lx"), "y0", "y1", "source", "confidence", F.posexplode(F.split("text", " ")).alias("pos", "text")).where("text <> ''")
    per_line = Window.partitionBy("doc_id", "page_index", "line_index").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("text") + 1).over(per_line), F.lit(0))
    n = F.count(F.lit(1)).over(per_line)
    placed = words.withColumn("x0", F.col("lx") + 8 * before + F.when(F.col("ln") % 7 == 3, 120).otherwise(0) * n).withColumn("span_index", n.cast("int"))
    return placed.select("doc_id", "page_index", "line_index", "span_index", "text", "x0", "y0", (F.col("x0") + 8 * F.octet_length("text")).alias("x1"), "y1", "source", "confidence")


def tokens(line_rows: DataFrame) -> DataFrame:
    """Characters of each line and a line break after it, in reading sequence within the page."""
    chars = line_rows.withColumn("c", F.concat(F.split("text", ""), F.array(F.lit("\n"))))
    ch = chars.select("doc_id", "page_index", "line_index", "x0", "y0", "y1", "source", F.posexplode("c").alias("pos", "text")).where("text <> ''")
    return ch.select("doc_id", "page_index", (F.col("line_index").cast("long") * 2**31 + F.col("pos")).alias("token_index"), F.when(F.col("text") == "\n", "line_break").otherwise("glyph").alias("kind"), "text", (F.col("x0") + 8 * F.col("pos")).alias("x0"), "y0", (F.col("x0") + 8 * F.col("pos") + 8).alias("x1"), "y1", "source")


def glyphs(lines: pa.RecordBatch) -> dict[str, np.ndarray]:
    """As columns, the glyphs that ``tokens`` makes of a batch of lines; see ``normalize.glyphs_to_lines``."""
    text = lines.column("text").fill_null("").cast(pa.large_string())
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = np.flatnonzero((data[off[0] : off[-1]] & 0xC0) != 0x80) + off[0]  # the first byte of each character
    count = np.diff(np.searchsorted(at, off))
    row = np.repeat(np.arange(len(text)), count)
    pos = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    side = {s: np.asarray(lines.column(s).to_numpy(zero_copy_only=False), np.float64) for s in ("x0", "y0", "y1")}
    x0 = side["x0"][row] + 8 * pos
    ink = (data[at] != 32) & (data[at] != 9)
    return {"row": row, "run": row, "ink": ink, "data": data, "start": at, "end": np.append(at[1:], off[-1:]), "x0": x0, "y0": side["y0"][row], "x1": x0 + 8, "y1": side["y1"][row]}
