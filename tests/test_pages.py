"""Reading order, layout recovery, matching and streams on small cases."""

import random

from folioframe.operators import evaluate, ordering, recovery, tables
from folioframe.streaming import run_state

B = ordering.Box


def order(*boxes):
    rows, broken = ordering.page_order(list(boxes))
    return [r["block_index"] for r in rows], broken


def test_two_columns_in_any_input_order():
    boxes = [B(0, "text", 600, 100, 900, 150), B(1, "text", 100, 180, 400, 230), B(2, "text", 600, 180, 900, 230), B(3, "text", 100, 100, 400, 150)]
    assert order(*boxes)[0] == [3, 1, 0, 2]
    random.Random(1).shuffle(boxes)
    assert order(*boxes)[0] == [3, 1, 0, 2]


def test_title_and_tail_span_the_columns():
    boxes = [B(0, "title", 100, 80, 900, 130), B(1, "text", 600, 180, 900, 230), B(2, "text", 100, 180, 400, 230), B(3, "text", 100, 280, 400, 330), B(4, "text", 600, 280, 900, 330), B(5, "text", 100, 500, 900, 550)]
    assert order(*boxes)[0] == [0, 2, 3, 1, 4, 5]


def test_caption_follows_its_figure():
    assert order(B(0, "figure", 100, 200, 500, 500), B(1, "text", 100, 100, 500, 140, target=0, is_caption=True))[0] == [0, 1]


def test_hint_is_a_soft_constraint():
    got, broken = order(B(0, "text", 100, 100, 500, 150, hint=10), B(1, "text", 100, 200, 500, 250, hint=1))
    assert got == [0, 1] and broken == [("model_hint", 0.25)]
    got, broken = order(B(0, "text", 100, 100, 500, 150, hint=20), B(1, "text", 100, 100, 500, 150, hint=10))
    assert got == [1, 0] and broken == []


def test_headers_first_footers_last():
    assert order(B(0, "footer", 100, 10, 200, 20), B(1, "text", 100, 100, 500, 150), B(2, "header", 100, 900, 200, 950))[0] == [2, 1, 0]


L, K = recovery.Line, recovery.Block


def test_recovery_adds_a_block_once():
    lines = [L(0, "assigned text", 100, 100, 400, 130), L(1, "missing text", 100, 500, 400, 530)]
    blocks, _ = recovery.recover(lines, [K("a", "text", 100, 100, 400, 130, [0])], 1, 1000, 1000)
    assert [b.id for b in blocks] == ["a", "page_1_fallback_line_2"]
    again, _ = recovery.recover(lines, blocks, 1, 1000, 1000)
    assert len(again) == 2


def test_line_under_a_header_is_not_recovered():
    blocks, _ = recovery.recover([L(0, "running head", 100, 20, 900, 50)], [K("h", "header", 80, 10, 920, 60)], 1, 1000, 1000)
    assert len(blocks) == 1


def test_page_edges_become_furniture():
    lines = [L(0, "some header words", 100, 20, 900, 50), L(1, "body text of the page", 100, 300, 900, 330), L(2, "42", 480, 940, 520, 970)]
    blocks, _ = recovery.recover(lines, [], 1, 1000, 1000)
    assert sorted((b.lines[0], b.type) for b in blocks) == [(0, "header"), (1, "text"), (2, "footer")]


def test_margin_numbers():
    at = [(150, 170), (300, 320), (450, 470), (600, 620), (750, 770)]
    mark = lambda ns: [L(i, str(n), 495, a, 517, b) for i, (n, (a, b)) in enumerate(zip(ns, at))]
    assert recovery.recover(mark([10, 15, 20, 30, 35]), [], 1, 1000, 1000)[0] == []
    assert len(recovery.recover(mark([42, 7, 91, 13, 68]), [], 1, 1000, 1000)[0]) == 5


def test_grid_reads_by_rows():
    lines = [L(3 * c + r, f"cell {c}{r}", x, y, x + 100, y + 20) for c, x in enumerate((100, 400, 700)) for r, y in enumerate((200, 280, 360))]
    blocks, _ = recovery.recover(lines, [], 1, 1000, 1000)
    assert [b.label for b in blocks] == ["text_grid_fallback"] and blocks[0].lines == [0, 3, 6, 1, 4, 7, 2, 5, 8]


def test_interleaved_columns_are_reordered():
    lines = [L(0, "a", 100, 100, 400, 120), L(1, "b", 600, 100, 900, 120), L(2, "c", 100, 150, 400, 170), L(3, "d", 600, 150, 900, 170)]
    assert recovery.column_lines(K("x", "text", 100, 100, 900, 170), lines) == [0, 2, 1, 3]


def test_continuation_is_attached():
    blocks, _ = recovery.recover([L(0, "first line", 100, 200, 500, 230), L(1, "second line", 100, 235, 500, 265)], [K("a", "text", 90, 195, 510, 232, [0])], 1, 1000, 1000)
    assert len(blocks) == 1 and blocks[0].y1 == 265 and blocks[0].lines == [0, 1]


def boxes(spark, rows):
    return spark.createDataFrame(rows, "page string, box_id int, x0 double, y0 double, x1 double, y1 double, confidence double")


def test_matching_is_maximum_not_greedy(spark):
    refs = boxes(spark, [("p", 0, 0.0, 0.0, 10.0, 10.0, 1.0), ("p", 1, 6.0, 0.0, 16.0, 10.0, 1.0)])
    preds = boxes(spark, [("p", 0, 3.0, 0.0, 13.0, 10.0, 1.0), ("p", 1, 0.0, 0.0, 10.0, 10.0, 1.0)])
    assert evaluate.match_boxes(refs, preds, ["page"]).count() == 2


def test_suppression_keeps_the_surest(spark):
    got = tables.suppress(boxes(spark, [("p", 0, 0.0, 0.0, 10.0, 10.0, 0.5), ("p", 1, 0.0, 0.0, 10.0, 9.9, 0.9), ("p", 2, 50.0, 0.0, 60.0, 10.0, 0.1)]), ["page"])
    assert sorted(r.box_id for r in got.collect()) == [1, 2]


def test_error_rates(spark):
    pairs = spark.createDataFrame([(1, "One two", "One too"), (2, "abc", None)], "id int, reference string, prediction string")
    got = {r.id: r for r in evaluate.error_rates(pairs, "id").collect()}
    assert (got[1].char_errors, got[1].word_errors, got[1].words) == (1, 1, 2) and abs(got[1].cer - 1 / 7) < 1e-12
    assert got[2].cer == 1.0 and got[2].missing


def test_stream_and_batch_agree(spark, tmp_path):
    schema = "run_id long, sequence long, type string, stage string, error string"
    rows = [(1, 1, "job_started", None, None), (1, 2, "stage_failed", "text", "e"), (1, 3, "job_succeeded", None, None), (1, 4, "job_failed", None, "f"), (2, 1, "job_started", "a", None), (2, 1, "job_succeeded", "b", None), (2, 2, "note", None, None)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = run_state.project_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.run_id: (r.status, r.last_sequence) for r in spark.table("states").collect()}
    assert got == {1: ("failed", 4), 2: ("running", 1)}
    assert {r.run_id: (r.status, r.last_sequence) for r in run_state.project(df.where("NOT (run_id = 2 AND type = 'job_succeeded')")).collect()} == got
