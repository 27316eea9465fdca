"""Registered queries of detection output, annotation files, evaluation, corpus checks and the service operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import detect, ordering, quality, service
from ..sources import annotations, synthetic
from ..sources.synthetic import PAGE
from .queries import _ITEMS, _blocks, _item_boxes, _items, _lines, query, read, run_events

_BOXES = f"SELECT l_orderkey, i, (l_partkey % 50)::DOUBLE AS x0, (l_suppkey % 20)::DOUBLE AS y0, l_partkey % 50 + l_quantity::DOUBLE AS x1, l_suppkey % 20 + 10.0::DOUBLE AS y1, l_returnflag AS label FROM ({_ITEMS})"
_IOU = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


def _case(labels: dict[str, str]) -> str:
    return "CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in labels.items()) + " ELSE 'unknown' END"


_LABELS = [*detect.DOCLAYNET, *detect.PADDLE, "Formula", "display_formula", ""]


@query(f"SELECT label, {_case(detect.DOCLAYNET)} AS doclaynet, {_case(detect.PADDLE)} AS paddle FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in dict.fromkeys(_LABELS))}) v(label)")
def label_maps(spark, d):
    labels = spark.createDataFrame([(x,) for x in dict.fromkeys(_LABELS)], "label string")
    return labels.select("label", detect.block_type(F.col("label"), detect.DOCLAYNET).alias("doclaynet"), detect.block_type(F.col("label"), detect.PADDLE).alias("paddle"))


@query(f"""SELECT l_orderkey, i, CASE WHEN a >= b THEN 'table' ELSE 'table rotated' END AS label, round(exp(greatest(a, b)) / (exp(a) + exp(b) + exp(c)), 9) AS confidence,
  (cx - w / 2) * 1000 AS x0, (cy - 0.0625) * 1400 AS y0, (cx + w / 2) * 1000 AS x1, (cy + 0.0625) * 1400 AS y1 FROM (
    SELECT l_orderkey, i, l_quantity::DOUBLE / 10 AS a, l_partkey % 7 AS b, l_suppkey % 3 AS c, (l_partkey % 16) / 16 AS cx, (l_suppkey % 8) / 8 AS cy, (l_linenumber % 4) / 8 AS w FROM ({_ITEMS}))
  WHERE exp(greatest(a, b)) / (exp(a) + exp(b) + exp(c)) > 0.9 AND w > 0""")
def detr_decode(spark, d):
    n = lambda c: F.col(c).cast("double")
    found = _items(spark, d).select("l_orderkey", "i", F.array(n("l_quantity") / 10, n("l_partkey") % 7, n("l_suppkey") % 3).alias("logits"), (n("l_partkey") % 16 / 16).alias("cx"), (n("l_suppkey") % 8 / 8).alias("cy"), (n("l_linenumber") % 4 / 8).alias("w"), F.lit(0.125).alias("h"))
    return detect.decode(found, ["table", "table rotated"], (1000, 1400), 0.9).withColumn("confidence", F.round("confidence", 9))


def _pictures(spark, d):
    kind = F.when(F.col("label") == "R", "image").when(F.col("label") == "A", "text").otherwise("inline_formula")
    return _item_boxes(spark, d).select("l_orderkey", "box_id", kind.alias("source_label"), "x0", "y0", (F.col("x1") + 40).alias("x1"), (F.col("y1") + 40).alias("y1"))


@query(f"""SELECT l_orderkey, box_id FROM (SELECT *, count(*) FILTER (NOT fills) OVER (PARTITION BY l_orderkey) AS others FROM (
  SELECT l_orderkey, i AS box_id, label = 'R' AND (x1 + 40 - x0) * (y1 + 40 - y0) > 0.93 * 3600 AS fills FROM ({_BOXES}))) WHERE NOT fills OR others = 0""")
def page_sized_images(spark, d):
    return detect.without_page_images(_pictures(spark, d), ["l_orderkey"], (60, 60)).select("l_orderkey", "box_id")


@query()
def overlap_filter(spark, d):
    return detect.without_overlaps(_pictures(spark, d), ["l_orderkey"])


def _regions(spark, d):
    b = _blocks(spark, d)
    return b.where("block_index % 3 = 0").select(*PAGE, F.col("block_index").alias("region"), F.when(F.col("block_index") % 2 == 0, "table").otherwise("table rotated").alias("label"), "x0", "y0", (F.col("x1") + 10).alias("x1"), "y1"), b


@query("""SELECT r.doc_id, r.page_index, r.region, r.x0, r.y0, r.x1, r.y1, (SELECT arg_max(b.block_index, greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) * (b.y1 - b.y0) / ((r.x1 - r.x0) * (r.y1 - r.y0)))
    FROM blocks b WHERE b.doc_id = r.doc_id AND b.page_index = r.page_index AND b.block_index = r.region AND (b.x1 - b.x0) / (r.x1 - r.x0) > 0.3) AS block_index
  FROM (SELECT doc_id, page_index, block_index AS region, x0, y0, x1 + 10 AS x1, y1 FROM blocks WHERE block_index % 6 = 0) r
  UNION ALL SELECT doc_id, page_index, (row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_index) - 1)::INTEGER, x0, y0, x1, y1, block_index FROM blocks b
  WHERE type = 'table' AND NOT EXISTS (SELECT 1 FROM blocks r WHERE r.block_index % 6 = 0 AND r.doc_id = b.doc_id AND r.page_index = b.page_index)""")
def table_regions(spark, d):
    return detect.table_regions(*_regions(spark, d))


@query("""SELECT doc_id, page_index, table_index, block_index, block_index % 5 <> 4 AND row_number() OVER (PARTITION BY doc_id, page_index, block_index ORDER BY table_index) = 1 AS attached FROM (
  SELECT doc_id, page_index, block_index AS table_index, block_index // 2 AS block_index FROM blocks)""")
def attach_tables(spark, d):
    b = _blocks(spark, d)
    t = b.select(*PAGE, F.col("block_index").alias("table_index"), F.expr("block_index div 2").cast("int").alias("block_index"))
    return detect.attach_tables(t, b.where("block_index % 5 <> 4").select(*PAGE, "block_index"))


_HALVES = "SELECT doc_id, page_index, block_index * 2 + h AS cell_id, x0 + h * (x1 - x0) / 2 AS x0, y0, x0 + (h + 1) * (x1 - x0) / 2 AS x1, y1, 0.75 AS confidence FROM blocks, (VALUES (0), (1)) v(h)"


@query(f"""SELECT c.doc_id, c.page_index, c.cell_id::INTEGER AS cell_id, c.x0, c.y0, c.x1, c.y1, coalesce(t.text, '') AS text, least(c.confidence, t.sure) AS confidence FROM ({_HALVES}) c LEFT JOIN (
  SELECT doc_id, page_index, cell_id, string_agg(text, ' ' ORDER BY r, x0, line_index, span_index) AS text, avg(sure) AS sure FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_index, cell_id ORDER BY mid, x0, line_index, span_index) AS r FROM (
      SELECT c.doc_id, c.page_index, c.cell_id, s.line_index, s.span_index, s.text, s.x0, s.confidence AS sure, (s.y0 + s.y1) / 2 AS mid,
        CASE WHEN (s.y0 + s.y1) / 2 - lag((s.y0 + s.y1) / 2) OVER (PARTITION BY c.doc_id, c.page_index, c.cell_id ORDER BY (s.y0 + s.y1) / 2, s.x0, s.line_index, s.span_index) > 3 THEN 1 ELSE 0 END AS fresh
      FROM ({_HALVES}) c JOIN spans s ON s.doc_id = c.doc_id AND s.page_index = c.page_index AND (s.x0 + s.x1) / 2 BETWEEN c.x0 AND c.x1 AND (s.y0 + s.y1) / 2 BETWEEN c.y0 AND c.y1))
  GROUP BY doc_id, page_index, cell_id) t ON t.doc_id = c.doc_id AND t.page_index = c.page_index AND t.cell_id = c.cell_id""")
def cell_texts(spark, d):
    lines = _lines(spark, d)
    half = _blocks(spark, d).withColumn("h", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("w", (F.col("x1") - F.col("x0")) / 2)
    cells = half.select(*PAGE, (F.col("block_index") * 2 + F.col("h")).alias("cell_id"), (F.col("x0") + F.col("h") * F.col("w")).alias("x0"), "y0", (F.col("x0") + (F.col("h") + 1) * F.col("w")).alias("x1"), "y1", F.lit(0.75).alias("confidence"))
    return detect.cell_texts(cells, detect.tokens(lines, synthetic.spans(lines)))


@query("""SELECT l_orderkey::VARCHAR || '.json' AS name, 'p' || i AS image, 1000 AS width, 1400 AS height, i AS object_id, label, x0, y0, x1, y1 FROM (""" + _BOXES + ")")
def coco_boxes(spark, d):
    b = _item_boxes(spark, d)
    found = F.struct(F.col("box_id").alias("id"), F.col("box_id").alias("image_id"), F.ascii("label").alias("category_id"), F.array("x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("bbox"))
    image = F.struct(F.col("box_id").alias("id"), F.concat(F.lit("p"), "box_id").alias("file_name"), F.lit(1000).alias("width"), F.lit(1400).alias("height"))
    lists = b.groupBy("l_orderkey").agg(F.collect_list(found).alias("annotations"), F.collect_list(image).alias("images"), F.collect_set(F.struct(F.ascii("label").alias("id"), F.col("label").alias("name"))).alias("categories"))
    return annotations.coco(lists.select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct("annotations", "images", "categories")).alias("content")))


@query("SELECT l_orderkey::VARCHAR AS name, 1000 AS width, 1400 AS height, label, x0, y0, x1, y1 FROM (" + _BOXES + ")")
def voc_boxes(spark, d):
    sides = [F.concat(F.lit(f"<{t}>"), F.col(c).cast("string"), F.lit(f"</{t}>")) for t, c in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))]
    item = F.concat(F.lit("<object><name>"), "label", F.lit("</name><bndbox>"), *sides, F.lit("</bndbox></object>"))
    files = _item_boxes(spark, d).groupBy(F.col("l_orderkey").cast("string").alias("name")).agg(F.concat(F.lit("<annotation><size><width>1000</width><height>1400</height></size>"), F.array_join(F.collect_list(item), ""), F.lit("</annotation>")).alias("content"))
    return annotations.voc(files)


@query("SELECT l_orderkey::VARCHAR AS name, '' AS table_id, (i - 1)::INTEGER AS row_index, c AS column_index, CASE c WHEN 0 THEN l_partkey::VARCHAR ELSE l_returnflag END AS text, NULL::VARCHAR AS error FROM (" + _ITEMS + "), (VALUES (0), (1)) v(c)")
def jats_cells(spark, d):
    row = F.concat(F.lit("<tr><td>"), F.col("l_partkey").cast("string"), F.lit("</td><th> "), "l_returnflag", F.lit(" </th></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", row.alias("r")))), lambda x: x["r"]), "")
    files = _items(spark, d).groupBy(F.col("l_orderkey").cast("string").alias("name")).agg(F.concat(F.lit("<article><table-wrap id=''><table>"), rows, F.lit("</table></table-wrap></article>")).alias("content"))
    return annotations.jats(files)


@query("SELECT conv_id::VARCHAR AS name, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS position, text, 10 AS x0, (turn * 40)::INTEGER AS y0, 90 AS x1, (turn * 40 + 20)::INTEGER AS y1 FROM conversations WHERE text <> ''")
def form_words(spark, d):
    box = F.array(F.lit(10), (F.col("turn") * 40).cast("int"), F.lit(90), (F.col("turn") * 40 + 20).cast("int"))
    word = F.struct(F.array(F.struct("text", box.alias("box"))).alias("words"))
    files = read(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("name")).agg(F.to_json(F.struct(F.collect_list(word).alias("form"))).alias("content"))
    return annotations.form_words(files).withColumn("position", F.col("position").cast("long"))


@query("SELECT 'truth' AS name, 'ocr_text' AS task, item_id::VARCHAR AS id, text FROM benchmark")
def ground_truth_samples(spark, d):
    # A file a few items long: the number of the file is a hash of the item.
    item = F.struct(F.col("item_id").cast("string").alias("id"), "text")
    files = read(spark, d, "benchmark").groupBy((F.col("item_id") % 8).alias("f")).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.lit("ocr_text").alias("task"), F.collect_list(item).alias("samples"))).alias("content"))
    return annotations.samples(files.select(F.lit("truth").alias("name"), "content")).select("name", "task", "id", "text")


@query(f"""SELECT l_orderkey, count(*) AS words, count(*) FILTER (seen) AS detected, count(*) FILTER (seen) / count(*) AS recall FROM (
  SELECT a.l_orderkey, a.i, EXISTS (SELECT 1 FROM ({_BOXES}) b WHERE b.l_orderkey = a.l_orderkey AND b.label = 'R' AND {_IOU} >= 0.5 * (a.x1 - a.x0) * (a.y1 - a.y0)) AS seen FROM ({_BOXES}) a) GROUP BY l_orderkey""")
def word_detection_recall(spark, d):
    b = _item_boxes(spark, d)
    return quality.word_recall(b.withColumnRenamed("box_id", "word_id"), b.where("label = 'R'"), ["l_orderkey"])


@query()
def anchor_alignment(spark, d):
    """The turns of each conversation as anchors, its texts in reverse order as blocks."""
    c = read(spark, d, "conversations")
    return quality.anchor_alignments(c.select("conv_id", F.col("turn").alias("rank"), "text"), c.select("conv_id", (-F.col("turn")).alias("position"), "text"), "conv_id")


@query()
def cell_text_scores(spark, d):
    b = _item_boxes(spark, d).withColumn("text", F.concat("label", F.col("box_id").cast("string")))
    return quality.cell_text_scores(b, b.where("label <> 'A'").withColumn("text", F.lower("text")), ["l_orderkey"], ignore_case=True)


_METRICS = """SELECT user_id AS report, CASE user_id % 4 WHEN 0 THEN 'backend' WHEN 1 THEN 'pipeline' WHEN 2 THEN 'product' ELSE 'other' END AS layer, event_type AS name, count(*) / 10 AS value,
  CASE WHEN event_type = 'view' THEN 'target' ELSE 'higher_is_better' END AS direction, CASE WHEN event_type = 'error' THEN 'lte' WHEN event_type <> 'view' THEN 'gte' END AS operator, 1.0 AS bound,
  CASE WHEN event_type = 'click' THEN count(*)::DOUBLE END AS numerator, CASE WHEN event_type = 'click' THEN (user_id % 3 * 10)::DOUBLE END AS denominator FROM events GROUP BY user_id, event_type"""


def _metrics(spark, d):
    e, u, n = F.col("event_type"), F.col("user_id"), F.count(F.lit(1))
    layer = F.element_at(F.array(*[F.lit(x) for x in (*quality.LAYERS, "other")]), (u % 4 + 1).cast("int"))
    got = read(spark, d, "events").groupBy("user_id", "event_type").agg(n.alias("n"))
    return got.select(u.alias("report"), layer.alias("layer"), e.alias("name"), (F.col("n") / 10).alias("value"), F.when(e == "view", "target").otherwise("higher_is_better").alias("direction"), F.when(e == "error", "lte").when(e != "view", "gte").alias("operator"), F.lit(1.0).alias("bound"), F.when(e == "click", F.col("n").cast("double")).alias("numerator"), F.when(e == "click", (u % 3 * 10).cast("double")).alias("denominator"))


@query(f"""SELECT report, evaluated, failed, missing, CASE WHEN failed > 0 THEN 'failed' WHEN missing <> '' OR evaluated = 0 THEN 'incomplete' ELSE 'passed' END AS status FROM (
  SELECT report, count(operator) AS evaluated, count(*) FILTER (CASE operator WHEN 'gte' THEN value < bound WHEN 'lte' THEN value > bound ELSE false END) AS failed,
    CASE WHEN max(layer) = 'backend' THEN '' ELSE 'backend' END AS missing FROM ({_METRICS}) GROUP BY report)""")
def quality_report(spark, d):
    return quality.report_status(_metrics(spark, d), spark.createDataFrame([("backend",)], "layer string"))


@query(f"""SELECT report, layer, name, rule FROM (SELECT *, unnest(list_filter([CASE WHEN layer = 'other' THEN 'layer_known' END, CASE WHEN operator IS NOT NULL AND operator <> CASE direction WHEN 'target' THEN 'eq' ELSE 'gte' END THEN 'operator_fits_direction' END,
  CASE WHEN denominator = 0 AND numerator <> 0 THEN 'zero_denominator' END, CASE WHEN denominator >= 0 AND abs(value - CASE WHEN denominator > 0 THEN numerator / denominator ELSE 0 END) > 1e-12 * greatest(1, abs(value)) THEN 'value_is_ratio' END], lambda x: x IS NOT NULL)) AS rule FROM ({_METRICS}))""")
def quality_report_violations(spark, d):
    return quality.report_violations(_metrics(spark, d))


@query(f"""WITH b AS ({_BOXES}), s AS (SELECT l_orderkey AS id, max(i) AS n FROM b GROUP BY 1)
  SELECT l_orderkey AS id, 'box_inside_image' AS rule, count(*) AS n FROM b WHERE x1 > 81 GROUP BY 1 UNION ALL SELECT l_orderkey, 'cell_inside_grid', count(*) FROM b JOIN s ON id = l_orderkey WHERE label = 'R' AND i = n GROUP BY 1
  UNION ALL SELECT l_orderkey, 'slots_held_once', count(*) FROM b a JOIN s ON id = l_orderkey
  WHERE label = 'R' AND i < n AND NOT EXISTS (SELECT 1 FROM b p WHERE p.l_orderkey = a.l_orderkey AND p.label = 'R' AND p.i = a.i + 1 AND p.i = n) GROUP BY 1 UNION ALL SELECT l_orderkey, 'grid_covered', 1 FROM b a JOIN s ON id = l_orderkey
  WHERE label = 'R' AND i = n AND NOT EXISTS (SELECT 1 FROM b p WHERE p.l_orderkey = a.l_orderkey AND p.i = a.i - 1 AND p.label = 'R')""")
def corpus_violations(spark, d):
    """One column of slots a sample, a cell for each line; returned ones reach a slot too far."""
    b = _item_boxes(spark, d).withColumnRenamed("l_orderkey", "id")
    samples = b.groupBy("id").agg(F.max("box_id").alias("n_rows"), F.lit(80).alias("width"), F.lit(80).alias("height"), F.lit(1).alias("n_columns"))
    cells = b.select("id", (F.col("box_id") - 1).alias("row_index"), F.lit(0).alias("column_index"), F.when(F.col("label") == "R", 2).otherwise(1).alias("row_span"), F.lit(1).alias("column_span"))
    return quality.corpus_violations(samples, b.select("id", "x0", "y0", "x1", "y1"), cells)


@query("""SELECT 'm' || doc_id % 3 AS manifest, doc_id::VARCHAR AS id, unnest(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'path_relative' END, CASE WHEN doc_id % 7 = 0 THEN 'sha256_hex' END, CASE WHEN source = 'web' THEN 'source_https' END], lambda x: x IS NOT NULL)) AS rule FROM documents""")
def manifest_violations(spark, d):
    i = F.col("doc_id")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    files = read(spark, d, "documents").select(
        F.concat(F.lit("m"), i % 3).alias("manifest"), i.cast("string").alias("id"), F.lit("ocr").alias("role"), F.concat(F.when(i % 5 == 0, "../").otherwise("a/"), i.cast("string")).alias("path"),
        F.when(i % 7 == 0, F.upper(F.concat(F.lit("a"), F.substring(digest, 2, 63)))).otherwise(digest).alias("sha256"), F.when(F.col("source") == "web", "http://example.org/a").otherwise("https://example.org/a").alias("url"), F.lit("https://example.org/l").alias("license_url"),
    )
    return quality.manifest_violations(files)


@query("""SELECT url AS path, octet_length(encode(b)) AS size, sha256(b) AS sha256, CASE WHEN page_id % 4 = 0 THEN 'content_type' WHEN octet_length(encode(b)) > 5000 THEN 'too_large' WHEN page_id % 3 <> 0 THEN 'signature' END AS problem
  FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN '%PDF-' ELSE '' END || coalesce(html, '') AS b FROM pages)""")
def upload_checks(spark, d):
    i = F.col("page_id")
    body = F.concat(F.when(i % 3 == 0, "%PDF-").otherwise(""), F.coalesce("html", F.lit("")))
    uploads = read(spark, d, "pages").select(F.col("url").alias("path"), F.when(i % 4 == 0, "text/html").otherwise("application/pdf").alias("content_type"), F.encode(body, "utf-8").alias("content"))
    return service.check_uploads(uploads, 5000)


@query("""SELECT o_orderkey AS job_id, CASE WHEN k % 11 = 0 THEN 'schema_version' WHEN k % 7 = 0 THEN 'uri' WHEN k % 5 = 0 THEN 'not_a_file' WHEN k % 3 = 0 THEN 'outside_root' WHEN k % 13 = 0 THEN 'limits' END AS problem FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")
def job_checks(spark, d):
    k = F.col("o_orderkey")
    name = k.cast("string")
    jobs = read(spark, d, "orders").select(k.alias("job_id"), F.when(k % 11 == 0, 2).otherwise(1).alias("schema_version"), F.concat(F.when(k % 7 == 0, "http://x/").otherwise("file:///run/tmp/../in/"), name).alias("uri"), F.lit(10).alias("size_bytes"), F.when(k % 3 == 0, "/run/../etc").otherwise("/run/out").alias("output_directory"), F.lit(60).alias("timeout_seconds"), F.when(k % 13 == 0, 0).otherwise(5).alias("maximum_pages"))
    files = read(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.concat(F.lit("/run/in/"), name).alias("path"), F.lit(10).cast("long").alias("length"), F.lit(service.SIGNATURE).alias("head"))
    return service.check_jobs(jobs, files, "/run")


@query("""SELECT event_id AS message_id, CASE WHEN event_id % 10 <> 0 AND event_id % 10 <> 1 THEN user_id::VARCHAR END AS run_id, CASE WHEN event_id % 10 <> 0 THEN event_id END AS sequence, CASE WHEN event_id % 10 <> 0 THEN event_type END AS type,
  CASE event_id % 10 WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'field_missing' END AS problem FROM events""")
def malformed_events(spark, d):
    i = F.col("event_id")
    body = F.to_json(F.struct(F.when(i % 10 != 1, F.col("user_id").cast("string")).alias("run_id"), i.alias("sequence"), F.col("event_type").alias("type")))
    messages = read(spark, d, "events").select(i.alias("message_id"), F.when(i % 10 == 0, F.substring(body, 1, 9)).otherwise(body).alias("body"))
    return service.sort_messages(messages).select("message_id", "run_id", "sequence", "type", "problem")


@query("""SELECT run_id, sequence, type FROM (SELECT *, coalesce(max((coalesce(type, '') = 'job_succeeded')::INTEGER) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM run_events WHERE sequence > 2) WHERE over = 0""")
def event_tail(spark, d):
    return service.event_tail(run_events(read(spark, d, "events")), 2).select("run_id", "sequence", "type")


@query("""SELECT doc_id, page_index, 'text' AS stage, 'text-line-' || (page_index + 1) || '-' || line_index AS item_id, 'text' AS kind, text, x0, y0, x1, y1, NULL::BIGINT AS "order" FROM lines UNION ALL
  SELECT doc_id, page_index, 'layout', 'layout-block-' || (page_index + 1) || '-' || block_index, type, text, x0, y0, x1, y1, NULL FROM blocks UNION ALL
  SELECT doc_id, page_index, 'reading_order', 'order-' || (page_index + 1) || '-' || s || '-' || block_index, type, text, x0, y0, x1, y1, s FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY CASE type WHEN 'header' THEN 0 WHEN 'footer' THEN 2 ELSE 1 END, (y0 + y1) / 2, x0, block_index) - 1 AS s FROM blocks)""")
def overlay_view(spark, d):
    b = _blocks(spark, d)
    return service.overlays(_lines(spark, d), b, ordering.single_column_order(b))


@query("""SELECT l_orderkey, i, greatest(0, floor(x0 / 3)::INTEGER - 4) AS x0, greatest(0, floor(y0 / 3)::INTEGER - 4) AS y0, least(30, ceil(x1 / 3)::INTEGER + 4) AS x1, least(20, ceil(y1 / 3)::INTEGER + 4) AS y1, (x1 - x0) * (y1 - y0) * 1.5 / (2 * (x1 - x0 + y1 - y0)) AS unclip FROM (""" + _BOXES + ")")
def crops(spark, d):
    b = _item_boxes(spark, d)
    unclip = G.unclip_offset(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), 1.5)
    thirds = b.where(G.valid()).withColumn("unclip", unclip).withColumns({c: F.col(c) / 3 for c in ("x0", "y0", "x1", "y1")})
    return thirds.select("l_orderkey", F.col("box_id").alias("i"), *[c.alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), G.padded_crop("", 4, (30, 20)))], "unclip")
