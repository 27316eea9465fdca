"""Detection filters, annotation files, alignment and service checks on small cases."""

import random

import pytest

from folioframe.operators import detect, quality, service
from folioframe.sources import annotations

BOX = "key int, box_id int, source_label string, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, label, *map(float, box)) for i, (label, box) in enumerate(rows)], BOX)


def kept(df):
    return sorted(r.box_id for r in df.collect())


@pytest.mark.parametrize(
    "rows, left",
    [
        ([("text", (0, 0, 100, 100)), ("text", (0, 0, 50, 100))], [0]),
        ([("text", (0, 0, 50, 100)), ("text", (0, 0, 100, 100))], [1]),
        ([("text", (0, 0, 100, 100)), ("image", (0, 0, 50, 100))], [0, 1]),
        ([("text", (0, 0, 100, 100)), ("table", (0, 0, 50, 100))], [0]),
        ([("image", (0, 0, 100, 100)), ("table", (0, 0, 50, 100))], [0, 1]),
        ([("text", (0, 0, 100, 100)), ("inline_formula", (10, 10, 40, 40))], [0]),
        ([("text", (0, 0, 100, 100)), ("inline_formula", (90, 90, 190, 190))], [0, 1]),
        ([("text", (0, 0, 5, 100)), ("text", (200, 0, 300, 100))], [1]),
    ],
)
def test_overlaps(spark, rows, left):
    assert kept(detect.without_overlaps(boxes(spark, *rows), ["key"])) == left


def test_a_page_keeps_its_only_picture(spark):
    whole, text = ("image", (0, 0, 100, 100)), ("text", (0, 0, 50, 10))
    assert kept(detect.without_page_images(boxes(spark, whole, text), ["key"], (100, 100))) == [1]
    assert kept(detect.without_page_images(boxes(spark, whole), ["key"], (100, 100))) == [0]


def test_sigmoid_scores(spark):
    found = spark.createDataFrame([(1, [0.0, -1.0], 0.5, 0.5, 0.5, 0.5), (2, [-0.1, -1.0], 0.5, 0.5, 0.5, 0.5)], "id int, logits array<double>, cx double, cy double, w double, h double")
    rows = detect.decode(found, ["a", "b"], (100, 200), 0.5, softmax=False).collect()
    assert [(r.id, r.label, r.confidence, r.x0, r.y0, r.x1, r.y1) for r in rows] == [(1, "a", 0.5, 25.0, 50.0, 75.0, 150.0)]


JATS = "<a><table-wrap id='t'><table><tr><th rowspan='2'>A</th><th colspan='2'>B <b>c</b></th></tr><tr><td>1</td><td>2</td></tr></table></table-wrap></a>"


def test_table_slots_follow_spans():
    assert annotations.table_slots(JATS) == [("t", 0, 0, "A", None), ("t", 0, 1, "B c", None), ("t", 1, 1, "1", None), ("t", 1, 2, "2", None)]
    assert [s[4] for s in annotations.table_slots(JATS.replace("rowspan='2'", "rowspan='3'"))] == ["outside", None, None, None]


def test_broken_files_give_no_rows(spark):
    files = spark.createDataFrame([("x", "<a"), ("y", None), ("z", JATS)], "name string, content string")
    assert {r.name for r in annotations.jats(files).collect()} == {"z"}
    for scan in (annotations.coco, annotations.voc, annotations.samples, annotations.form_words):
        assert scan(files.where("name <> 'z'")).count() == 0


def test_form_words_of_a_row_go_from_left_to_right(spark):
    content = '{"form":[{"words":[{"text":"b","box":[50,10,60,20]},{"text":"a","box":[10,15,20,25]},{"text":"","box":[1,1,2,2]}]},{"words":[{"text":"c","box":[0,40,9,50]}]}]}'
    rows = annotations.form_words(spark.createDataFrame([("f", content)], "name string, content string")).orderBy("position").collect()
    assert [r.text for r in rows] == ["a", "b", "c"]


def test_sample_errors(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {(r.rule, r.id) for r in annotations.sample_errors(ids("a", "a", "b"), ids("b", "c")).collect()} == {("reference_unique", "a"), ("prediction_known", "c")}


def test_alignment_takes_the_best_block_and_its_place(spark):
    anchors = spark.createDataFrame([(1, 0, "world of text"), (1, 1, "Hello  there"), (2, 0, "lost")], "id int, rank int, text string")
    held = spark.createDataFrame([(1, 1, "well hello there"), (1, 2, "world of text")], "id int, position int, text string")
    rows = {(r.id, r.rank): (r.aligned, r.position) for r in quality.anchor_alignments(anchors, held, "id").collect()}
    assert rows == {(1, 0): (13, 1.0), (1, 1): (11, 5 / 16), (2, 0): (0, None)}


def test_report_without_thresholds_is_incomplete(spark):
    rows = [("a", "backend", "m", 1.0, None, None), ("b", "backend", "m", 0.5, "gte", 0.6), ("c", "backend", "m", 0.6, "eq", 0.6 + 1e-14)]
    metrics = spark.createDataFrame(rows, "report string, layer string, name string, value double, operator string, bound double")
    status = lambda layers: {r.report: r.status for r in quality.report_status(metrics, spark.createDataFrame([(x,) for x in layers], "layer string")).collect()}
    assert status(["backend"]) == {"a": "incomplete", "b": "failed", "c": "passed"}
    assert status(["backend", "product"]) == {"a": "incomplete", "b": "failed", "c": "incomplete"}


def test_paths_lose_their_dots(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("/a/./b//../c",), ("/../x",), ("/",)], "p string").select(service.normal_path(F.col("p")).alias("p"))
    assert [r.p for r in got.collect()] == ["/a/c", "/x", "/"]


def test_bad_messages_are_kept_with_a_problem(spark):
    bodies = [(1, '{"run_id":"r","sequence":1,"type":"job_started"}'), (2, "[1]"), (3, "{"), (4, None), (5, '{"run_id":"r","type":"x"}')]
    rows = service.sort_messages(spark.createDataFrame(bodies, "message_id int, body string")).collect()
    assert {r.message_id: r.problem for r in rows} == {1: None, 2: "not_an_object", 3: "not_an_object", 4: "not_an_object", 5: "field_missing"}


def test_retry_delays_double_up_to_the_largest():
    draw = random.Random(1)
    for failures, top in ((1, 1), (2, 2), (4, 8), (9, 30)):
        assert top / 2 <= service.retry_delay(1, 30, failures, draw) <= top
    with pytest.raises(ValueError):
        service.retry_delay(2, 1, 1)
