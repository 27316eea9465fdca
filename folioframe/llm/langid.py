"""Language identification by nearest centroid of TF-IDF character n-grams.

A text's letters, in lower case and with one space for anything else, give hashed 1- to 3-grams. Their weights
(1 + log count) * idf, normalised to length 1, are compared by cosine with several centroids per language, found by
spherical k-means over a sample. The best centroid's language is the prediction. Its distance 1 - cosine decides on
rejection: a language accepts cosines down to REJECT_SHARE of its sample's median, and less for short texts, whose
few n-grams lie far from any centroid by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import crc_mod, table, without

DIMENSIONS = 1 << 14
CENTROIDS = 3
SAMPLE_PER_LANGUAGE = 300  # training documents of each language, at most
MAX_LANGUAGES = 500  # languages learned, at most: those of the most documents
REJECT_SHARE = 0.35  # a long text is rejected below this share of the median cosine of its language's sample
UNDETERMINED = "und"
CHUNK = 1 << 20  # code points that are hashed at once

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 32 for everything else."""
    global _LETTERS
    if _LETTERS is None:
        out = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _LETTERS = out
    return _LETTERS


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed dimensions of a text's 1- to 3-grams of letters (runs of other characters count as one space), with counts."""
    total = np.zeros(DIMENSIONS, np.int64)
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), CHUNK):
        points = _letters()[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        points = np.concatenate([tail, points, np.array([32], np.uint32)[: at + CHUNK >= len(text)]])
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])].astype(np.uint64)
        if len(points) >= 3:
            a, b, c = points[:-2], points[1:-1], points[2:]
            one, two, three = b * np.uint64(0x9E3779B1), (a * np.uint64(0x85EBCA77) + b) * np.uint64(0x9E3779B1) + np.uint64(1 << 40), ((a * np.uint64(0x85EBCA77) + b) * np.uint64(0xC2B2AE3D) + c) * np.uint64(0x9E3779B1) + np.uint64(1 << 41)
            for h in (one[b != 32], two, three):
                total += np.bincount(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64), minlength=DIMENSIONS)
        tail = points[-2:].astype(np.uint32)
    where = np.flatnonzero(total)
    return where, total[where]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class Model:
    """Centroids (one row each), their languages, idf, and each language's largest accepted distance for long texts."""

    def __init__(self, centroids: np.ndarray, languages: list[str], idf: np.ndarray, bounds: dict[str, float]):
        self.centroids, self.languages, self.idf, self.bounds = centroids, languages, idf, bounds
        self.columns = np.ascontiguousarray(centroids.T)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        where, count = ngram_counts(text)
        weight = (1 + np.log(count)) * self.idf[where]
        norm = np.sqrt((weight**2).sum())
        return where, weight / norm if norm else weight

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1) and whether it is rejected. No letter or nothing learned: und, 0, rejected."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        where, weight = self.vector(text)
        cosine = weight @ self.columns[where]
        best = int(np.argmax(cosine))
        lang, score = self.languages[best], float(min(1.0, max(0.0, cosine[best])))
        short = 1.0 / np.sqrt(1.0 + len(where) / 40.0)
        return lang, score, bool(1 - score > self.bounds[lang] + short * (1 - self.bounds[lang]))


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the mean and then the row farthest from the centres so far."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        near = (x @ np.array([c / max(np.linalg.norm(c), 1e-12) for c in centres]).T).max(axis=1)
        centres.append(x[int(np.argmin(near))])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> Model:
    """Learns from documents with a language whose crc32(doc_id) modulo 4 is not 2.

    At most SAMPLE_PER_LANGUAGE of each language, those of the smallest hash of id and text, and the MAX_LANGUAGES
    languages of the most documents; the driver gets only their n-gram counts, once for repeated rows. A text without a
    letter teaches nothing. Only rows whose hash lies in the lowest part of its range that should hold twice as many
    are ranked, so the task that ranks a language gets no more rows from more input. An empty table gives a model that
    rejects all. Runs jobs when called.
    """
    known = docs.where(F.col(lang).isNotNull() & (crc_mod(doc_id, 4) != 2))
    named = known.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.xxhash64(text).alias("th")).withColumn("h", F.xxhash64("id", "th"))
    # At most MAX_LANGUAGES rows.
    held = F.broadcast(named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES))
    low = named.join(held, "lang").where((F.col("h") / 2.0**64 + 0.5) * F.col("n") <= 2 * SAMPLE_PER_LANGUAGE).select("id", "lang", "th", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "th"))
    sample = low.withColumn("r", rank).where(f"r <= {SAMPLE_PER_LANGUAGE}").select("id", "lang", "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, t in enumerate(batch.column("text").to_pylist()) if has_letter(t)]
            part = batch.take(pa.array(kept, pa.int64()))
            counts = [ngram_counts(t) for t in part.column("text").to_pylist()]
            lists = [pa.array([c[k].astype(np.int32) for c in counts], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), part.column("th"), *lists], ["id", "lang", "th", "where", "count"])

    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").withColumn("th", F.xxhash64("text"))
    # The sample has SAMPLE_PER_LANGUAGE rows a language, of MAX_LANGUAGES: small enough to broadcast.
    met = texts.join(F.broadcast(sample), ["id", "th"]).select("id", "lang", "th", "text")
    fields = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("id", "lang", "th"))
    counted = met.mapInArrow(run, f"{fields}, where array<int>, count array<int>")
    got = counted.groupBy("id", "lang", "th").agg(F.first("where").alias("where"), F.first("count").alias("count")).toArrow()
    arrays = lambda name: [x.values.to_numpy() for x in got.column(name)]
    rows = sorted(zip(got.column("lang").to_pylist(), arrays("where"), arrays("count")), key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    seen = np.ones(DIMENSIONS)
    for _, where, _ in rows:
        seen[where] += 1
    idf = np.log((1 + len(rows)) / seen) + 1
    centroids, languages, bounds = [], [], {}
    for lg in sorted({r[0] for r in rows}):
        x = np.zeros((sum(r[0] == lg for r in rows), DIMENSIONS), np.float32)
        for i, (_, where, count) in enumerate(r for r in rows if r[0] == lg):
            x[i, where] = (1 + np.log(count)) * idf[where]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _cluster(x, CENTROIDS)
        bounds[lg] = 1 - REJECT_SHARE * float(np.median((x @ c.T).max(axis=1)))
        centroids.append(c)
        languages += [lg] * len(c)
    return Model(np.concatenate(centroids) if centroids else np.zeros((0, DIMENSIONS)), languages, idf, bounds)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with lang_pred, score (cosine, 0 to 1) and rejected.

    Null texts and texts without a letter are ``und``, score 0, rejected. Rows are judged each for itself; an empty
    table gives none. Input columns named like a result are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = without(docs, ["lang_pred", "score", "rejected"]).columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [held.value.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    at = names.index(text) if text in names else len(names)
    src = docs.select(*[F.col(f"`{c}`") for c in names], *([] if text in names else [F.col(text).alias("__text")]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(names)])
    return src.mapInArrow(run, (f"{fields}, " if fields else "") + "lang_pred string, score double, rejected boolean")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """identify for all documents; null doc_ids are not held out and teach nothing. Runs jobs when called."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs), keep=["doc_id"])
    return found.select("doc_id", (F.coalesce(crc_mod("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", "rejected")
