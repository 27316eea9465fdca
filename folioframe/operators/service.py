"""Service operators as batch queries: uploads, jobs, events and the views of a run's stages."""

from __future__ import annotations

import random
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.synthetic import PAGE

SIGNATURE = b"%PDF-"
MAX_UPLOAD = 100 * 1024 * 1024
FINAL_EVENTS = ("job_succeeded", "job_failed", "job_cancelled")


def check_uploads(uploads: DataFrame, largest: int = MAX_UPLOAD) -> DataFrame:
    """path, size, sha256 and problem (null: accepted) of uploads (path, content_type, content)."""
    head = F.substring("content", 1, len(SIGNATURE))
    problem = F.when(~F.coalesce(F.col("content_type") == "application/pdf", F.lit(False)), "content_type").when(F.length("content") > largest, "too_large").when(~F.coalesce(head == F.lit(SIGNATURE), F.lit(False)), "signature")
    return uploads.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), problem.alias("problem"))


def normal_path(path: Column) -> Column:
    """The path without empty, ``.`` and ``..`` steps."""
    step = lambda done, s: F.when(s.isin("", "."), done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def check_jobs(jobs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """job_id and problem (null: accepted), the first of the checks that fails.

    jobs: job_id, schema_version, uri, size_bytes (0 or null: not said), output_directory, timeout_seconds, maximum_pages;
    files: path, length, head (its first bytes)."""
    asked = jobs.withColumn("path", F.when(F.col("uri").startswith("file://"), normal_path(F.substring("uri", 8, 1 << 20))))
    inside = lambda p: F.coalesce((p == root) | p.startswith(root + "/"), F.lit(False))
    both = asked.join(files, "path", "left")
    within = lambda c, top: F.coalesce(F.col(c).between(1, top), F.lit(False))
    problem = (
        F.when(~F.coalesce(F.col("schema_version") == 1, F.lit(False)), "schema_version").when(F.col("path").isNull(), "uri").when(F.col("length").isNull(), "not_a_file")
        .when(~inside(F.col("path")) | ~inside(normal_path(F.col("output_directory"))), "outside_root").when((F.col("size_bytes") > 0) & (F.col("size_bytes") != F.col("length")), "size")
        .when(~F.coalesce(F.substring("head", 1, 5) == F.lit(SIGNATURE), F.lit(False)), "signature").when(~within("timeout_seconds", 86400) | ~within("maximum_pages", 10000), "limits")
    )
    return both.select("job_id", problem.alias("problem"))


def sort_messages(messages: DataFrame) -> DataFrame:
    """messages (message_id, body) with run_id, sequence, type and problem: bodies that are no JSON object, or lack a
    field, stay as rows with a problem, for a quarantine table; rows without one go on."""
    d = messages.withColumn("v", F.try_parse_json("body"))
    field = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    out = d.select("message_id", "body", F.schema_of_variant("v").startswith("OBJECT").alias("whole"), field("run_id", "string").alias("run_id"), field("sequence", "bigint").alias("sequence"), field("type", "string").alias("type"))
    problem = F.when(~F.coalesce("whole", F.lit(False)), "not_an_object").when(F.col("run_id").isNull() | F.col("sequence").isNull() | F.col("type").isNull(), "field_missing")
    return out.withColumn("problem", problem).drop("whole")


def envelopes(events: DataFrame, order: list[str]) -> DataFrame:
    """events (run_id, ...) with sequence, from 1 in each run by ``order``, and event_id; both replace such columns."""
    n = F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).cast("long")
    numbered = events.withColumn("sequence", n)
    return numbered.withColumns({"schema_version": F.lit(1), "event_id": F.concat(F.lit("evt_"), F.col("run_id").cast("string"), F.lit("_"), F.col("sequence"))})


def event_tail(events: DataFrame, after: int = 0) -> DataFrame:
    """Each run's events after sequence ``after``, up to the first that ends the run."""
    before = Window.partitionBy("run_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.col("type").isin(*FINAL_EVENTS).cast("int")).over(before), F.lit(0))
    return events.where(F.col("sequence") > after).withColumn("over", over).where("over = 0").drop("over")


def retry_delay(initial: float, largest: float, failures: int, draw: random.Random | None = None) -> float:
    """Seconds to wait after a number of failures in a row: drawn from the upper half of a doubling, capped delay."""
    if initial <= 0 or largest < initial or failures < 1:
        raise ValueError("the delays must be positive and in order, the failures at least one")
    top = min(largest, initial * 2 ** min(failures - 1, 30))
    return (draw or random).uniform(top / 2, top)


def overlays(lines: DataFrame, blocks: DataFrame, order: DataFrame) -> DataFrame:
    """What a viewer draws: (page, stage, item_id, kind, text, box, order) of text lines, layout blocks and their order."""
    page = F.col("page_index") + 1
    shape = lambda df, stage, item, kind, number: df.select(*PAGE, F.lit(stage).alias("stage"), item.alias("item_id"), kind.alias("kind"), "text", "x0", "y0", "x1", "y1", number.cast("long").alias("order"))
    name = lambda head, index: F.concat(F.lit(head), page.cast("string"), F.lit("-"), F.col(index).cast("string"))
    none = F.lit(None)
    ranked = blocks.join(order.select(*PAGE, "block_index", "sequence_index"), [*PAGE, "block_index"])
    parts = [shape(lines, "text", name("text-line-", "line_index"), F.lit("text"), none), shape(blocks, "layout", name("layout-block-", "block_index"), F.col("type"), none)]
    return parts[0].unionByName(parts[1]).unionByName(shape(ranked, "reading_order", F.concat(name("order-", "sequence_index"), F.lit("-"), F.col("block_index").cast("string")), F.col("type"), F.col("sequence_index")))


def create_runs(asked: DataFrame, documents: DataFrame, workers: DataFrame, registered: dict[str, tuple[str, ...]]) -> DataFrame:
    """run_id, document_id, status (202 accepted, 422, 409, 404), problem (null: accepted) and job (JSON) of requests.

    asked: run_id, document_id, dpi, timeout_seconds, maximum_pages and a column of the backend's name per stage;
    documents: document_id, path, size_bytes, sha256; workers: worker_id and an array of backends per stage. In this
    order: a name that is not registered is 422, one that not every worker has is 409 (without workers all count), an
    unknown document is 404. Names are compared as they are; a null name is not registered.
    """
    stages = list(registered)
    # One row: the backends that all workers have, per stage.
    shared = workers.agg(F.count_distinct("worker_id").alias("__w"), *[F.collect_list(s).alias("__" + s) for s in stages])
    has = lambda s: (F.col("__w") == 0) | ~F.exists("__" + s, lambda held: ~F.array_contains(held, F.col(s)))
    unknown = F.coalesce(*[F.when(~F.coalesce(F.col(s).isin(*registered[s]), F.lit(False)), F.lit(s)) for s in stages])
    lacking = F.coalesce(*[F.when(~F.coalesce(has(s), F.lit(False)), F.lit(s)) for s in stages])
    both = asked.join(documents, "document_id", "left").join(F.broadcast(shared))  # one row
    status = F.when(unknown.isNotNull(), 422).when(lacking.isNotNull(), 409).when(F.col("path").isNull(), 404).otherwise(202)
    problem = F.coalesce(F.concat(F.lit("unknown backend: "), unknown), F.concat(F.lit("no common capability: "), lacking), F.when(F.col("path").isNull(), "document not found"))
    source = F.struct(F.concat(F.lit("file://"), "path").alias("uri"), "sha256", "size_bytes")
    limits = F.struct("timeout_seconds", "maximum_pages")
    job = F.struct(F.lit(1).alias("schema_version"), F.concat(F.lit("job_"), "run_id").alias("job_id"), "document_id", "run_id", source.alias("input"), F.struct("dpi", F.struct(*stages).alias("backends")).alias("pipeline"), limits.alias("limits"))
    return both.select("run_id", "document_id", status.alias("status"), problem.alias("problem"), F.when(status == 202, F.to_json(job)).alias("job"))


def next_reads(messages: DataFrame, pending: DataFrame, consumer: str, now: Column, idle_seconds: int = 30, count: int = 50) -> DataFrame:
    """message_id and via of what a consumer reads next, at most ``count``, by id: its own pending messages (``own``),
    else those that another has held for ``idle_seconds`` (``claimed``), else messages that nobody has (``new``).

    messages: message_id, those after the group's last; pending: message_id, consumer, since (a timestamp).
    """
    age = F.unix_timestamp(now) - F.unix_timestamp("since")
    held = pending.select("message_id", F.when(F.col("consumer") == consumer, 0).when(age >= idle_seconds, 1).alias("way")).where("way IS NOT NULL")
    fresh = messages.join(pending, "message_id", "left_anti").select("message_id", F.lit(2).alias("way"))
    # The first rows by way and id: each task keeps ``count`` of its own.
    first = held.unionByName(fresh).orderBy("way", "message_id").limit(count)
    best = first.agg(F.min("way").alias("best"))
    return first.join(F.broadcast(best), F.col("way") == F.col("best")).select("message_id", F.element_at(F.array(F.lit("own"), F.lit("claimed"), F.lit("new")), F.col("way") + 1).alias("via"))


def retained(events: DataFrame, now: Column, longest: int = 2000, days: int = 7) -> DataFrame:
    """Events (run_id, sequence, at) that are still held: the last ``longest`` of each run by its gapless sequence, and
    none of a run whose last event is older than ``days``. Sums per run are joined, so no run is sorted."""
    last = events.groupBy("run_id").agg(F.max("sequence").alias("__last"), F.max("at").alias("__at"))
    alive = last.where(F.col("__at") >= now - F.make_dt_interval(F.lit(days)))
    return events.join(alive, "run_id").where(F.col("sequence") > F.col("__last") - longest).drop("__last", "__at")


def live_workers(beats: DataFrame, now: Column, expire_seconds: int = 30) -> DataFrame:
    """worker_id and last_beat of the workers whose last beat (worker_id, at) is not over ``expire_seconds`` old."""
    last = beats.groupBy("worker_id").agg(F.max("at").alias("last_beat"))
    return last.where(F.unix_timestamp(now) - F.unix_timestamp("last_beat") <= expire_seconds)


def stage_view(pages: DataFrame, blocks: DataFrame, stage: str) -> DataFrame:
    """What a stage made of each document: doc_id, page_number, output (JSON).

    ``assembly`` and ``export``: one row of the document's blocks (page_number null). ``render``: each page's image.
    Other stages: the page's debug output of that name (pages: doc_id, page_number, image, debug map<string,string>;
    ``text`` and ``table`` are held as text and tables), null if it has none."""
    if stage in ("assembly", "export"):
        listed = F.transform(F.array_sort(F.collect_list(F.struct("global_order", "id", "type", "text"))), lambda b: F.struct(b["id"].alias("id"), b["type"].alias("type"), b["text"].alias("text")))
        return blocks.groupBy("doc_id").agg(F.to_json(F.struct(listed.alias("blocks"))).alias("output")).select("doc_id", F.lit(None).cast("int").alias("page_number"), "output")
    output = F.col("image") if stage == "render" else F.try_element_at("debug", F.lit({"table": "tables"}.get(stage, stage)))
    return pages.select("doc_id", "page_number", output.alias("output"))


class EngineCache:
    """Engines by their backends, the least recently used one leaving when a new one is ready and the cache is full.

    One a Python worker process: models are loaded once for many batches. An engine that cannot be made raises its
    error and costs no other its place."""

    def __init__(self, make: Callable[[tuple], object], capacity: int = 2):
        if capacity < 1:
            raise ValueError("the capacity must be positive")
        self.make, self.capacity, self.held = make, capacity, OrderedDict()

    def get(self, backends: tuple) -> object:
        if backends not in self.held:
            engine = self.make(backends)
            if len(self.held) == self.capacity:
                self.held.popitem(last=False)
            self.held[backends] = engine
        self.held.move_to_end(backends)
        return self.held[backends]
