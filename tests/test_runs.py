"""Backends, model inputs, annotated tables, run service and streams on small cases."""

import json
import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioframe.operators import detect, inputs, quality, service, tables
from folioframe.sources import backends
from folioframe.streaming import jobs


def test_order_file():
    order = backends.read_order('{"version": 1, "auto_order": {"ocr": ["noop", "paddle"]}}')
    assert order["ocr"] == ("noop", "paddle") and order["layout"] == backends.REGISTERED["layout"]
    assert backends.select_backends("ocr", "auto", order) == ("noop", "paddle")
    assert backends.select_backends("ocr", "tesseract", order) == ("tesseract",)


@pytest.mark.parametrize("text", ["[]", "{", '{"x": 1}', '{"version": 2}', '{"auto_order": []}', '{"auto_order": {"x": ["a"]}}', '{"auto_order": {"ocr": "paddle"}}', '{"auto_order": {"ocr": [1]}}', '{"auto_order": {"ocr": []}}', '{"auto_order": {"ocr": ["noop", "noop"]}}', '{"auto_order": {"ocr": ["auto"]}}', '{"auto_order": {"ocr": ["doclaynet"]}}'])
def test_wrong_order_files(text):
    with pytest.raises(ValueError):
        backends.read_order(text)


def test_chain(spark):
    rows = spark.createDataFrame([(1, 2), (None, 3), (None, None)], "a int, b int")
    got = rows.select(backends.chain([("a", F.col("a")), ("b", F.col("b"))]).alias("c")).select("c.*").collect()
    assert [(r.result, r.backend, r.failed) for r in got] == [(1, "a", []), (3, "b", ["a"]), (None, None, ["a", "b"])]


def test_sizes(spark):
    w, h = F.lit(1920), F.lit(1000)
    r = spark.range(1).select(*inputs.detection_size(w, h), *inputs.table_size(w, h), *inputs.table_size(w, h, 800, 800), *inputs.render_size(F.lit(612.0), F.lit(792.0), 200)).first()
    assert list(r) == [960, 512, 1000, 521, 800, 417, 1700, 2200]
    assert list(spark.range(1).select(*inputs.detection_size(F.lit(3), F.lit(40))).first()) == [32, 32]


def test_ranked_layout(spark):
    schema = "k int, row_index int, label_number double, score double, x0 double, y0 double, x1 double, y1 double, rank double"
    rows = [(1, 0, 22.0, 0.9, 0.0, 0.0, 50.0, 10.0, 2.0), (1, 1, 6.0, 0.9, 0.0, 20.0, 150.4, 30.0, 1.0), (1, 2, 18.0, 0.9, 0.0, 40.0, 50.0, 60.0, 0.0), (1, 3, 22.0, 0.5, 0.0, 40.0, 50.0, 60.0, 0.0), (1, 4, 25.0, 0.9, 0.0, 40.0, 50.0, 60.0, 0.0), (1, 5, 22.0, 0.9, 200.0, 0.0, 250.0, 10.0, 0.0)]
    got = detect.ranked_layout(spark.createDataFrame(rows, schema), ["k"], (100, 100)).orderBy("box_id").collect()
    assert [(r.box_id, r.source_label, r.type, r.x1) for r in got] == [(0, "doc_title", "title", 100.0), (1, "text", "text", 50.0)]


def box_rows(spark, rows, more=""):
    return spark.createDataFrame(rows, f"table_id int, x0 double, y0 double, x1 double, y1 double{more}")


def test_annotated_tables_with_problems(spark):
    def sides(*boxes):
        return [(t, *map(float, b)) for t in (1, 2, 3, 4) for b in boxes]

    rows, columns = box_rows(spark, sides((0, 0, 20, 10), (0, 10, 20, 20))), box_rows(spark, sides((0, 0, 10, 20), (10, 0, 20, 20)))
    spans = [(1, 0.0, 0.0, 20.0, 10.0, True), (2, 0.0, 0.0, 20.0, 10.0, False), (2, 0.0, 0.0, 10.0, 20.0, False), (3, 50.0, 50.0, 60.0, 60.0, False)]
    slots = [(t, r, c, f"{r}{c}") for t in (1, 2, 3) for r in (0, 1) for c in (0, 1)] + [(4, 0, 0, "x")]
    cells, problems = quality.reference_cells(rows, columns, box_rows(spark, spans, ", projected boolean"), box_rows(spark, []), spark.createDataFrame(slots, "table_id int, row_index int, column_index int, text string"))
    assert sorted(tuple(r) for r in problems.collect()) == [(2, "spans_overlap"), (3, "span_without_slot"), (4, "grids_differ")]
    got = sorted((r.table_id, r.row_index, r.column_index, r.row_span, r.column_span, r.is_header, r.text) for r in cells.collect())
    assert got == [(1, 0, 0, 1, 2, True, "00 01"), (1, 1, 0, 1, 1, False, "10"), (1, 1, 1, 1, 1, False, "11")]


def test_a_table_without_headers_has_no_header_cells(spark):
    rows, columns = spark.createDataFrame([(1, 0.0, 10.0)], "table_id int, y0 double, y1 double"), spark.createDataFrame([(1, 0.0, 10.0)], "table_id int, x0 double, x1 double")
    none = box_rows(spark, [])
    assert [r.is_header for r in tables.grid(rows, columns, none, none).collect()] == [False]


def test_alignment_is_that_of_the_first_best_block():
    draw = random.Random(5)
    word = lambda n: "".join(draw.choices("abc ", k=draw.randint(0, n)))
    texts, blocks = [word(9) for _ in range(300)], [[word(14) for _ in range(draw.randint(0, 5))] for _ in range(300)]
    found = quality.best_alignment.func(pd.Series(texts), pd.Series(blocks))
    for text, held, n, at in zip(texts, blocks, found["matched"], found["position"]):
        best, where = 0, 0.0
        for i, block in enumerate(held):
            runs = SequenceMatcher(None, text, block, autojunk=False).get_matching_blocks()
            if sum(r.size for r in runs) > best:
                best, where = sum(r.size for r in runs), i + max(runs, key=lambda r: r.size).b / len(block)
        assert (n, at) == (best, where)


def test_run_requests(spark):
    asked = spark.createDataFrame([("r1", "d1", 200, 60, 5, "pdf", "noop"), ("r2", "d2", 200, 60, 5, "pdf", "noop"), ("r3", "d1", 200, 60, 5, "pdf", "x"), ("r4", "d1", 200, 60, 5, "pdf", None)], "run_id string, document_id string, dpi int, timeout_seconds int, maximum_pages int, document string, ocr string")
    documents = spark.createDataFrame([("d1", "/a.pdf", "ff", 3)], "document_id string, path string, sha256 string, size_bytes int")
    nobody = spark.createDataFrame([], "worker_id string, document array<string>, ocr array<string>")
    stages = {s: backends.REGISTERED[s] for s in ("document", "ocr")}
    got = {r.run_id: r for r in service.create_runs(asked, documents, nobody, stages).collect()}
    assert [got[k].status for k in sorted(got)] == [202, 404, 422, 422]
    assert json.loads(got["r1"].job)["input"] == {"uri": "file:///a.pdf", "sha256": "ff", "size_bytes": 3}
    busy = spark.createDataFrame([("w", ["pdf"], ["paddle"])], nobody.schema)
    assert {r.status for r in service.create_runs(asked.where("run_id = 'r1'"), documents, busy, stages).collect()} == {409}


@pytest.mark.parametrize("pending, expected", [([(2, "a", 0), (1, "b", 99)], [(2, "own")]), ([(1, "b", 30), (2, "b", 29)], [(1, "claimed")]), ([(1, "b", 29)], [(2, "new"), (3, "new")])])
def test_next_reads(spark, pending, expected):
    now = F.expr("TIMESTAMP '2024-01-01 00:10:00'")
    held = spark.createDataFrame(pending, "message_id long, consumer string, age int").selectExpr("message_id", "consumer", "TIMESTAMP '2024-01-01 00:10:00' - make_interval(0, 0, 0, 0, 0, 0, age) AS since")
    messages = spark.createDataFrame([(1,), (2,), (3,)], "message_id long")
    assert sorted(tuple(r) for r in service.next_reads(messages, held, "a", now).collect()) == expected


def test_retention_and_heartbeats(spark):
    at = "TIMESTAMP '2024-01-08 00:00:00'"
    e = spark.sql("SELECT 1 AS run_id, id AS sequence, TIMESTAMP '2024-01-01 00:00:00' AS at FROM range(1, 6) UNION ALL SELECT 2, 1, TIMESTAMP '2023-12-31 23:59:59'")
    assert sorted((r.run_id, r.sequence) for r in service.retained(e, F.expr(at), 2, 7).collect()) == [(1, 4), (1, 5)]
    beats = spark.sql("SELECT 'a' AS worker_id, TIMESTAMP '2024-01-07 23:59:30' AS at UNION ALL SELECT 'b', TIMESTAMP '2024-01-07 23:59:29'")
    assert [r.worker_id for r in service.live_workers(beats, F.expr(at)).collect()] == ["a"]


def test_stage_view(spark):
    blocks = spark.createDataFrame([(1, 1, "b", "text", "y"), (1, 0, "a", "title", "x")], "doc_id int, global_order int, id string, type string, text string")
    row = service.stage_view(None, blocks, "export").first()
    assert row.page_number is None and [b["id"] for b in json.loads(row.output)["blocks"]] == ["a", "b"]


def test_engine_cache():
    made = []

    def make(key):
        made.append(key)
        if key == ("bad",):
            raise RuntimeError("not ready")
        return object()

    cache = service.EngineCache(make)
    a = cache.get(("a",))
    cache.get(("b",))
    with pytest.raises(RuntimeError):
        cache.get(("bad",))
    assert cache.get(("a",)) is a
    cache.get(("c",))
    cache.get(("b",))
    assert made == [("a",), ("b",), ("bad",), ("c",), ("b",)]
    with pytest.raises(ValueError):
        service.EngineCache(make, 0)


def test_streams(spark, tmp_path):
    schema = "run_id long, sequence long, type string, stage string, error string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, 1, "job_started", None, None), (1, 2, "stage_started", "ocr", None)], [(1, 3, "job_succeeded", None, None), (2, 1, "job_queued", None, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(schema).parquet(source)
        jobs.sink_events(events, out, str(tmp_path / "c1"), availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{out}/events").count() == 4
    got = {r.run_id: (r.status, r.stage, r.last_sequence) for r in jobs.latest_runs(spark.read.parquet(f"{out}/run_changes")).collect()}
    assert got == {1: ("succeeded", "ocr", 3), 2: ("queued", None, 1)}


def test_a_failed_batch_counts_as_read(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def handle(batch):
        if batch.where("job_id = 'bad'").count():
            raise RuntimeError("no engine")
        return batch.select("job_id", F.lit("succeeded").alias("status"), F.lit(None).cast("string").alias("error"))

    for job in ("bad", "good"):
        spark.createDataFrame([(job,)], "job_id string").coalesce(1).write.mode("append").parquet(source)
        jobs.run_jobs(spark.readStream.schema("job_id string").parquet(source), handle, out, str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert {r.job_id: (r.status, r.error) for r in spark.read.parquet(f"{out}/jobs").collect()} == {"bad": ("failed", "no engine"), "good": ("succeeded", None)}
