"""The pipeline's stages, each held against a plain version of what it should keep."""

from collections import Counter

import corpus_pipeline as P
from folioframe.llm import langid, mixing, shards
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_near, plain_mix, slow_language
from tests.oracle import SF


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def clean_of_items(rows, items):
    return [r.doc_id for r in rows if not any(len(s & shingles(r.text)) >= 0.8 * len(s) for s in items)]


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "mixture", "sharding"]

    one = stages["language_id"](spark, docs, SF)
    model = langid.fit(docs)
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in docs.collect() if not slow_language(model, r.text)[2])

    two = stages["near_duplicates"](spark, one, SF)
    assert sorted(r.doc_id for r in two.collect()) == brute_near({r.doc_id: r.text for r in one.collect()})

    three = stages["decontamination"](spark, two, SF)
    items = [s for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (s := shingles(r.text))]
    assert sorted(r.doc_id for r in three.collect()) == sorted(clean_of_items(two.collect(), items))

    four = stages["mixture"](spark, three, SF)
    rows = three.select("doc_id", "source", "text", mixing.n_words(F.col("text")).alias("n"), F.md5(F.concat_ws(":", F.lit("30"), "doc_id", mixing.n_words(F.col("text")).cast("string"), F.xxhash64("text").cast("string"))).alias("h")).collect()
    want = plain_mix([(r.source, r.n) for r in rows], lambda i: rows[i].h)
    mixed = four.collect()
    assert Counter(r.doc_id for r in mixed) == Counter({r.doc_id: want[i][2] for i, r in enumerate(rows) if want[i][2]})
    texts = {r.doc_id: r.text for r in rows}
    assert all(r.text == texts[r.doc_id] for r in mixed)
    for stage in (one, two, three, four):
        assert stage.columns == docs.columns

    # Whole fractional ranks by plain sorting; copies of a row are interchangeable.
    import hashlib
    import zlib

    five = stages["sharding"](spark, four, SF).collect()
    crc = lambda t: zlib.crc32(t.encode())
    key = lambda r: (hashlib.md5(f"{shards.SEED}:{r.doc_id}:{crc(r.text)}:{len(r.text.encode()) + 1}".encode()).hexdigest(), r.doc_id)
    per, line, place = {}, [], Counter()
    for r in sorted(mixed, key=key):
        per.setdefault(r.source, []).append(r)
    for s, rs in per.items():
        line += [((2 * i + 1) / (2 * len(rs)), "1" if s is None else "0" + s, key(r), r.doc_id) for i, r in enumerate(rs)]
    for p, x in enumerate(sorted(line)):
        place[x[3], p * 16 // len(line)] += 1
    assert Counter((r.doc_id, r.shard) for r in five) == place
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in five) == Counter((r.doc_id, r.text, r.lang, r.source) for r in mixed)
    run = P.run(spark, SF)
    assert set(docs.columns) | {"shard", "slot", "size", "text_crc32"} == set(run.columns) and run.count() == len(five)


def test_stages_on_awkward_tables(spark):
    """Nulls, repeats, ties, blank and long texts and clashing names: no crash, and each stage keeps what it should."""
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (2, "", "en", "s", 0), (5, long, "en", "s", 1), (5, long, "en", "s", 1), (None, None, None, None, None)], base.schema)
    names = ("score", "rejected", "shard", "slot", "size", "words", "k", "rounds", "__k", "__h", "__all", "__th", "__d", "__t", "fp", "target", "n", "w", "label", "row")
    docs = base.unionByName(odd).withColumns({c: F.lit("x") for c in names})
    for _, stage in P.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns and docs.where("score <> 'x' OR __all <> 'x' OR words <> 'x'").isEmpty()
        ids = {r.doc_id for r in before.collect()}
        assert {r.doc_id for r in docs.collect()} <= ids and docs.count() > 0
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("text IS NULL").isEmpty()


def test_stages_on_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0, name
