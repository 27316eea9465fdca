"""Edit distance in words against a plain table, with more words than any coding in characters could hold."""

import random

from folioframe.functions import text as T
from folioframe.plans.queries import QUERIES
from pyspark.sql import functions as F

from .oracle import SF


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        was, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            was, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, was + (x != y))
    return row[-1]


def test_word_distance(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choices("abcd", k=rng.randrange(30))), " \t".join(rng.choices("abcd", k=rng.randrange(30)))) for _ in range(300)]
    rows += [("", ""), ("a b", ""), ("", "a b c"), (None, "a"), ("é ü", "é u")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.word_distance("a", "b").alias("n")).collect()
    assert [r.n for r in got] == [None if a is None else plain(a.split(), b.split()) for a, b in rows]


def test_word_distance_of_fifty_thousand_words(spark):
    words = [f"w{i}" for i in range(50_000)]
    changed = [*words[:45_568], "x", *words[45_569:], "y"]
    df = spark.createDataFrame([(" ".join(words), " ".join(changed))], "a string, b string")
    assert df.select(T.word_distance("a", "b").alias("n")).first().n == 2


def test_word_errors_query(spark):
    said = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    low = lambda t: T.UPPER and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    got = QUERIES["word_errors"](spark, SF).withColumn("n", F.col("word_errors")).collect()
    assert len(got) == len(said)
    for r in got:
        a, b = low(said[r.conv_id, r.turn]), low(said.get((r.conv_id, r.turn + 1)))
        assert (r.words, r.n) == (len(a), plain(a, b)) and r.wer == (r.n / len(a) if a else float(r.n > 0))
