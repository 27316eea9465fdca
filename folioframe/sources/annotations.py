"""Annotation and OCR files as rows: each scan takes a frame with one file a row (``name``, ``content``), as
``spark.read.text(path, wholetext=True)`` gives it, and explodes it. A file that cannot be parsed gives no rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import map_groups

BOX = ("x0", "y0", "x1", "y1")
_SAMPLES = """version int, task string, dataset string, samples array<struct<id:string,text:string,width:int,height:int,
  objects:array<struct<label:string,mapped_label:string,bbox:array<double>,confidence:double>>,
  cells:array<struct<row_index:int,column_index:int,row_span:int,column_span:int,text:string,bbox:array<double>>>,
  anchors:array<struct<id:string,text:string>>,reading_order:array<string>,blocks:array<struct<text:string>>>>"""
_COCO = "images array<struct<id:long,file_name:string,width:int,height:int>>, categories array<struct<id:long,name:string>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>>>"
_VOC = "size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def samples(files: DataFrame) -> DataFrame:
    """name, task, dataset and the fields of each sample of ground truth or predictions."""
    doc = files.select("name", F.from_json("content", _SAMPLES).alias("d"))
    return doc.select("name", "d.task", "d.dataset", F.explode("d.samples").alias("s")).select("name", "task", "dataset", "s.*")


def sample_errors(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """(rule, id): ids that repeat on a side, and predictions of unknown samples."""
    say = lambda df, rule: df.select(F.lit(rule).alias("rule"), "id")
    twice = lambda df: df.groupBy("id").count().where("count > 1")
    return say(twice(references), "reference_unique").unionByName(say(twice(predictions), "prediction_unique")).unionByName(say(predictions.join(references, "id", "left_anti").select("id").distinct(), "prediction_known"))


def coco(files: DataFrame) -> DataFrame:
    """name, image, width, height, object_id, label and box of every annotation."""
    d = files.select("name", F.from_json("content", _COCO).alias("d"))
    part = lambda c, a: d.select("name", F.explode(f"d.{c}").alias(a))
    found = part("annotations", "a").select("name", F.col("a.id").alias("object_id"), "a.image_id", "a.category_id", "a.bbox")
    images = part("images", "i").select("name", F.col("i.id").alias("image_id"), F.col("i.file_name").alias("image"), "i.width", "i.height")
    kinds = part("categories", "c").select("name", F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    return found.join(images, ["name", "image_id"]).join(kinds, ["name", "category_id"]).select("name", "image", "width", "height", "object_id", "label", x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def voc(files: DataFrame) -> DataFrame:
    """name, width, height, label and box of every object."""
    d = files.select("name", F.from_xml("content", _VOC).alias("d")).select("name", "d.size", F.explode("d.object").alias("o"))
    sides = [F.coalesce(f"o.bndbox.{s}", F.lit(0.0)).alias(b) for s, b in zip(("xmin", "ymin", "xmax", "ymax"), BOX)]
    return d.select("name", F.coalesce("size.width", F.lit(0)).alias("width"), F.coalesce("size.height", F.lit(0)).alias("height"), F.coalesce("o.name", F.lit("unknown")).alias("label"), *sides)


def table_slots(content: str) -> list[tuple[str, int, int, str, str | None]]:
    """(table id, row, column, text, error) of the cells of every table-wrap of a JATS file, placed by their spans."""
    out: list[tuple[str, int, int, str, str | None]] = []
    for wrap in ET.fromstring(content).iter("table-wrap"):
        name, table = wrap.get("id", ""), wrap.find("table")
        trs = [] if table is None else list(table.iter("tr"))
        used: set[tuple[int, int]] = set()
        for r, tr in enumerate(trs):
            c = 0
            for cell in (e for e in tr if e.tag in ("th", "td")):
                while (r, c) in used:
                    c += 1
                down, across = int(cell.get("rowspan", "1")), int(cell.get("colspan", "1"))
                covered = {(i, j) for i in range(r, r + down) for j in range(c, c + across)}
                error = "span" if not covered else "overlap" if covered & used else "outside" if r + down > len(trs) else None
                out.append((name, r, c, " ".join("".join(cell.itertext()).split()), error))
                used |= covered
                c += across
    return out


def jats(files: DataFrame) -> DataFrame:
    """name, table_id, row_index, column_index, text, error (span, overlap, outside or null) of table cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [(name, *slot) for slot in table_slots(content or "")]
                except (ET.ParseError, ValueError):
                    continue
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            names = ["name", "table_id", "row_index", "column_index", "text", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    return files.select("name", "content").mapInArrow(run, "name string, table_id string, row_index int, column_index int, text string, error string")


def form_words(files: DataFrame) -> DataFrame:
    """name, position, text and box of the words of form annotations, top to bottom; words within eight pixels of
    height of each other go from left to right."""
    form = "form array<struct<words:array<struct<text:string,box:array<int>>>>>"
    lists = files.select("name", F.from_json("content", form).alias("d")).select("name", F.posexplode("d.form").alias("f", "item"))
    word = lists.select("name", "f", F.posexplode("item.words").alias("w", "v")).where("size(v.box) >= 4 AND v.text <> ''")
    rows = word.select("name", (F.col("f") * 100_000 + F.col("w")).alias("position"), "v.text", *[F.get("v.box", F.lit(i)).alias(b) for i, b in enumerate(BOX)])

    def group(rows: list[dict]) -> list[dict]:
        rows.sort(key=lambda r: (r["y0"], r["x0"], r["position"]))
        for i in range(1, len(rows)):
            at = i
            while at and abs(rows[at]["y0"] - rows[at - 1]["y0"]) <= 8 and rows[at]["x0"] < rows[at - 1]["x0"]:
                rows[at], rows[at - 1] = rows[at - 1], rows[at]
                at -= 1
        return [{**r, "position": i} for i, r in enumerate(rows)]

    return map_groups(rows, ["name"], group)
