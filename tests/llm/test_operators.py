"""The ten operators against SQL, brute force, exact round trips and held-out labels, and on awkward tables."""

import gzip
import hashlib
import itertools
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from folioframe.llm import _words, bpe, chat, decontaminate, langid, lines, mixing, queries, rulefit, shards, simhash, warc
from tests.oracle import SF, assert_same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, blank, tiny and very long texts, repeated rows and ids, clashing extra columns."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, "one", "en", "t", 3), (5, long, "en", "s", len(long)), (5, long, "en", "s", len(long)), (6, "x" * 100_000, "fr", "s", 1), (7, "é ü 漢字 😀", "fr", "t", 7), (7, "another text for the same id", "fr", "t", 7), (8, "one", "en", "t", 3), (9, "12 34", "en", "t", 5)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("shard", "slot", "taken", "target", "score", "rejected", "component", "fp", "h", "w", "__k", "__h", "__th", "text_hash")})


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.SQL[name])


# --- words and hashes


def test_vectorised_xxh64_of_all_lengths():
    data = bytes(random.Random(3).randrange(256) for _ in range(2000)) + b"\0" * 8
    start = np.array([0, 1, 5, 7, 11] * 200)
    end = start + np.arange(1000)
    for seed in (0, 42):
        assert _words.xxh64(data, start, end, seed).tolist() == [xxhash.xxh64_intdigest(data[a:b], seed) for a, b in zip(start.tolist(), end.tolist())]


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_code_is_perfect():
    words = np.random.default_rng(1).integers(0, 1 << 23, 500).astype(np.uint32)
    simhash.golay_index(words)
    assert len(set(simhash._LEADERS.tolist())) == 2048 and max(bin(x).count("1") for x in simhash._LEADERS.tolist()) == 3
    assert {len(set(r)) for r in simhash.fuzzy_indices(words).tolist()} <= {1, 6}


def test_every_close_pair_shares_a_key():
    rng = random.Random(5)
    for n in (1, 2, 3) * 150:
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), n))
        pair = np.array([simhash._signed(a), simhash._signed(b)], np.int64)
        (sk, sr), (pk, pr) = simhash.join_keys(pair, False), simhash.join_keys(pair, True)
        for x, y in ((0, 1), (1, 0)):
            assert set(pk[pr == x].tolist()) & set(sk[sr == y].tolist())


def test_every_pair_of_six_bits_shares_a_near_key():
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 4, 5, 6, 6, 6, 6) * 100:
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), n))
        pair = np.array([simhash._signed(a), simhash._signed(b)], np.int64)
        (sk, sr), (pk, pr) = simhash.near_keys(pair, False), simhash.near_keys(pair, True)
        for x, y in ((0, 1), (1, 0)):
            assert set(pk[pr == x].tolist()) & set(sk[sr == y].tolist())


def brute_components(rows):
    fps = {i: int(f, 16) for i, f in rows}
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_components(spark, docs):
    got = simhash.simhash_components(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.fingerprint == f"{slow_fingerprint(texts[r.doc_id]):016x}" for r in got)
    want = brute_components([(r.doc_id, r.fingerprint) for r in got])
    assert {r.doc_id: r.component_id for r in got} == want


def slow_profile(text):
    """The weighted SimHash of the words and the SimHash of five-word shingles, bit by bit."""
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (text or "").encode().split()]
    if not w:
        return 0, 0
    weight = {x: int(16 * n**0.5 * min(len(x), 16)) for x, n in Counter(w).items()}
    h = {x: xxhash.xxh64_intdigest(x, 42) for x in weight}
    fp = sum(1 << b for b in range(64) if 2 * sum(weight[x] for x in weight if h[x] >> b & 1) > sum(weight.values()))
    five = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))]
    return fp, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in five) > len(five))


def brute_near(texts):
    """The ids that stay of {id: text}: the smallest of each group of near copies, every pair compared."""
    fps, parent = {i: slow_profile(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i][0] ^ fps[j][0]).bit_count() <= 6 and (fps[i][1] ^ fps[j][1]).bit_count() <= 14:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted({find(i) for i in ids})


def test_near_copies_stay_once(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    assert list(zip(*simhash.profiles_of([texts[i] for i in ids]))) == [tuple(map(simhash._signed, slow_profile(texts[i]))) for i in ids]
    kept = simhash.simhash_dedup(docs)
    assert sorted(r.doc_id for r in kept.collect()) == brute_near(texts) and kept.columns == docs.columns


def test_near_copies_of_planted_texts(spark):
    """Copies with a word in twenty-five changed or a passage moved go; others stay, in a cluster too tight for pairs."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    vocabulary = [word() for _ in range(3000)]
    rows, heads = [], []
    for group in range(30):
        base = rng.choices(vocabulary, k=200)
        heads.append(len(rows))
        rows.append((len(rows), " ".join(base)))
        for _ in range(8):
            copy = list(base)
            for at in rng.sample(range(200), 4):
                copy[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).upper()))
    got = [r.doc_id for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == brute_near(dict(rows)) and set(heads) <= set(got) and len(got) <= 30 + 0.1 * 240


def test_ties_stand_for_links(spark):
    """A chain of tight clusters: the same components as by all pairs, though few pairs are given out."""
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
    rows = [(i, simhash._signed(f)) for i, f in enumerate(sorted(fps))]
    nodes = spark.createDataFrame([(f,) for _, f in rows], "fp long")
    pairs = simhash.links(nodes).count()
    assert pairs == sum((a ^ b).bit_count() <= 3 for a, b in itertools.combinations(fps, 2))
    # What the ties do not compare lies under crowded keys.
    two, crowded, _ = simhash.ties(nodes, simhash.THREE_BITS)
    tied = {frozenset((r.a, r.b)) for r in two.collect()}
    under = {frozenset((r.a, r.b)) for r in simhash.links(nodes, only=crowded).collect()}
    assert len(tied | under) == pairs
    got = {r.id: r.component for r in simhash.components(spark.createDataFrame(rows, "id long, fp long"), "id").collect()}
    assert got == brute_components([(i, f"{f & (2**64 - 1):x}") for i, f in rows])


@pytest.mark.parametrize("few", [0, simhash.FEW])
def test_hooking_follows_a_long_chain(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    n = 60
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([tuple(sorted(p)) for p in zip(order, order[1:])], "a long, b long")
    assert {r.label for r in simhash.hook(edges)[0].collect()} == {0}


@pytest.mark.parametrize("few, jobs", [(0, 200), (150, 12), (simhash.FEW, 6)])
def test_hooking_finds_the_components_in_few_jobs(spark, monkeypatch, few, jobs):
    """Rounds of joins for a few pairs filled the driver's memory."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(5)
    pairs = [(a, b) for a in range(-30, 30) for b in rng.choices(range(a % 6 - 30, 30, 6), k=14) if a != b]
    least = {x: x for p in pairs for x in p}
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    node = lambda x: F.struct((F.col(x) % 7).alias("fp"), F.col(x).alias("five")).alias(x)
    groups = {}
    for x, y in least.items():
        groups.setdefault(y, []).append((math.fmod(x, 7), x))
    edges = spark.createDataFrame(pairs, "a long, b long").select(node("a"), node("b")).repartition(4).cache()
    spark.sparkContext.setJobGroup(f"hook {few}", "")
    labels, path = simhash.hook(edges)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"hook {few}")) <= jobs
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((tuple(r.node), tuple(r.label)) for r in labels.collect()) == sorted((x, min(xs)) for xs in groups.values() for x in xs)


def test_simhash_on_awkward_rows(awkward):
    got = simhash.simhash_components(awkward).collect()
    assert len(got) == awkward.count()
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert [r.doc_id for r in got if r.doc_id is None] == [None]
    kept = simhash.simhash_dedup(awkward).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, None, 4, 5, 6, 7, 7, 9])


# --- lines, tokens, language, quality


def test_line_rules():
    keep = "A full sentence stands here."
    text = "\n".join([keep, "Accueil", "", "Nos services", "Plan du site", keep, "WOW!! BUY!! NOW!!", "a » b » c » d", "Well.", "A title", "Two lines are no menu", "So be it.", "Voir www.a.b", "Tous droits réservés.", "© ACME", "Impressum und mehr.", ""])
    cleaned, failed, lost = lines.clean(text)
    assert cleaned == "\n".join([keep, "", "Well.", "A title", "Two lines are no menu", "So be it.", ""])
    assert failed == {"punctuation": 1, "navigation": 3 + 1 + 1, "boilerplate": 1 + 3} and lost == 1 + 2 + 3 + 5 + 3 + 7 + 2 + 3 + 2 + 3
    assert lines.in_menus([True, True, False, True, True, True, True]) == [False] * 3 + [True] * 4 and lines.in_menus([]) == []


def test_lines_on_awkward_rows(awkward):
    got = {r.doc_id: r for r in lines.line_quality(awkward).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[5].n_words == 60_000 and got[6].word_chars == 100_000


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.Counter(bpe.load(path))
    hard = ["", "a<|endoftext|>b <|startoftext|>", "Σίσυφος ΟΔΟΣ ΣΑΣ", "don't I'LL we've", "café ́x", "a\x1cb \x85 c d", "İstanbul ǅ", "漢字かな", "😀👍🏽", "½ ² 123", "x" * 3000, "ab" * 1500, "!!!???", "\x00\x01", "a<|endoftext|>́b", "ẞ ﬁ 한글"]
    texts = hard + [r.text for r in docs.collect()]
    assert [own.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = bpe.token_counts(docs, path).orderBy("doc_id").first()
    assert got.over_limit == (got.n_tokens > bpe.LIMIT)


def test_language_id_held_out(spark, docs):
    model = langid.fit(docs)
    got = langid.identify(docs, model, keep=["doc_id", "lang"])
    held = got.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in held)
    assert model.predict(None)[0] == model.predict("12 34")[0] == "und"
    assert model.predict("xqzw kkjv wwxq zzkq vvxk qqzx kkww xxzz qjqj wkwk zxzx" * 20)[2]
    assert sum(r.rejected for r in got.collect()) <= 0.01 * docs.count()


def test_language_id_on_awkward_rows(awkward):
    got = langid.identify(awkward, langid.fit(awkward), keep=["doc_id"])
    assert got.count() == awkward.count() and {r.lang_pred for r in got.where("doc_id IN (1, 2, 3, 9)").collect()} == {"und"}


def test_quality_rules_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = rulefit.fit(docs, labels)
    rows = rulefit.statistics(docs).toPandas()
    scored = rulefit.score(docs, model).toPandas().merge(rows, on="doc_id")
    assert np.allclose(scored["score"], model.score(scored[list(rulefit.STATISTICS)].to_numpy()))
    both = rulefit.score(docs, model).join(labels, "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).collect()
    assert sum(r.quality == r.predicted for r in both) >= 0.9 * len(both)


def test_quality_rules_without_labels(spark, awkward):
    model = rulefit.fit(awkward, spark.createDataFrame([], "doc_id long, quality int"))
    assert rulefit.score(awkward, model).count() == awkward.count()


# --- shards and mixture


def crc(text):
    return zlib.crc32((text or "").encode())


def test_interleaving_brute_force(spark, docs):
    rows = [(r.doc_id, r.source, len((r.text or "").encode()) + 1, crc(r.text)) for r in docs.collect()]
    per, pos = {}, []
    key = lambda r: (hashlib.md5(f"{shards.SEED}:{r[0]}:{r[3]}:{r[2]}".encode()).hexdigest(), r[0], r[3], r[2])
    for r in sorted(rows, key=key):
        per.setdefault(r[1], []).append(r)
    for s, rs in per.items():
        pos += [((2 * i + 1) / (2 * len(rs)), s, *key(r)) for i, r in enumerate(rs)]
    pos.sort()
    want, seen = {}, Counter()
    for p, x in enumerate(pos):
        sh = p * 16 // len(pos)
        want[x[3]] = (sh, seen[sh])
        seen[sh] += 1
    got = {r.doc_id: (r.shard, r.slot) for r in queries.QUERIES["op2_interleaved_shards"](spark, SF).collect()}
    assert got == want


def test_shards_follow_the_mixture_on_awkward_rows(awkward):
    got = shards.interleave(awkward, shards=4).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == awkward.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def plain_mix(rows, key, blocks=mixing.BLOCKS, n_shards=mixing.SHARDS):
    """taken, shards' words and whole copies of each of rows (source, size), by plain loops. key(i): what is shuffled."""
    md5 = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    names = sorted({("1" if s is None else "0" + s) for s, _ in rows})
    size = {k: sum(n for s, n in rows if ("1" if s is None else "0" + s) == k) for k in names}
    weight = {k: 1 + i % 3 for i, k in enumerate(names)}
    total, target, full = sum(size.values()), {}, set()
    while True:  # sources above their caps stop there, one round after another
        rest, still = total - sum(3 * size[k] for k in full), sum(weight[k] for k in names if k not in full)
        target = {k: 3.0 * size[k] if k in full else rest * weight[k] / still for k in names}
        over = {k for k in names if target[k] > 3 * size[k]}
        if not over:
            break
        full |= over
    block = max(-(-total // blocks), 1)
    words = {k: int(target[k] + 0.5) for k in names if block > 1 and target[k] < 200 * block}
    seats, n = {k: [] for k in names}, (total - sum(words.values())) // block
    for r in range(n):  # the highest quotient next
        k = min((k for k in names if k not in words and len(seats[k]) < 3 * size[k] // block), key=lambda k: (-target[k] / (2 * len(seats[k]) + 1), k), default=None)
        if k is not None:
            seats[k].append(r * n_shards // n)
    out = {}
    for k in names:
        own = sorted((i for i, (s, _) in enumerate(rows) if ("1" if s is None else "0" + s) == k), key=key)
        shard_of = {}  # place in the repeated stream -> shard, by word
        if k in words:
            turn = int(md5(k)[:4], 16)
            for i in range(n_shards):
                for x in range(words[k] * i // n_shards, words[k] * (i + 1) // n_shards):
                    shard_of[x] = (i + turn) % n_shards
            rounds = words[k] // size[k] if size[k] else 0
        elif seats[k]:
            rounds = len(seats[k]) * block // size[k]
            whole = -(-rounds * size[k] // block)
            open_ = range(whole, min(-(-(rounds + 1) * size[k] // block), 3 * size[k] // block))
            chosen = [*range(whole), *sorted(open_, key=lambda j: md5(mixing.SEED, k, j))[: len(seats[k]) - whole]]
            for j, shard in zip(sorted(chosen, key=lambda j: md5(mixing.SEED + 1, k, j)), seats[k]):
                for x in range(j * block, (j + 1) * block):
                    shard_of[x] = shard
        at = 0
        for i in own:
            got = Counter(shard_of[x] for r in range(3) for x in range(r * size[k] + at, r * size[k] + at + rows[i][1]) if x in shard_of)
            spot = at + (rows[i][1] // 2 if k in words else 0)
            copies = sum(r * size[k] + spot in shard_of for r in range(3)) if rows[i][1] else 0
            out[i] = (sum(got.values()), sorted(got.items()), copies, target[k], size[k])
            at += rows[i][1]
    return out


def seeded_key(ids, *rest):
    return lambda i: (hashlib.md5(":".join(["30", *["null" if x[i] is None else str(x[i]) for x in (ids, *rest)]]).encode()).hexdigest(),)


def test_mix_against_plain_loops(spark, docs):
    rows = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("n")).collect()
    want = plain_mix([(r.source, r.n) for r in rows], seeded_key([r.doc_id for r in rows], [r.n for r in rows]))
    want = {r.doc_id: want[i] for i, r in enumerate(rows)}
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("__size"))
    got = mixing.mix(sized, ties=("__size",)).collect()
    assert {r.doc_id: (r.taken, [tuple(p) for p in r.shards]) for r in got} == {i: w[:2] for i, w in want.items()}
    assert all(abs(r.target - want[r.doc_id][3]) < 1e-6 and r.source_size == want[r.doc_id][4] for r in got)


def quotas_of(df, **options):
    return {(r.shard, r.source): r.quota * r.block for r in mixing.shard_quotas(df, **options).collect()}


def test_shards_take_their_quotas_exactly(spark, docs):
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("__size"))
    taken = Counter()
    rows = mixing.mix(sized).collect()
    for r in rows:
        for p in r.shards:
            taken[p.shard, r.source] += p.words
    assert taken == quotas_of(sized)
    per_shard = Counter()
    for (shard, _), n in taken.items():
        per_shard[shard] += n
    assert max(per_shard.values()) - min(per_shard.values()) <= 0.01 * sum(per_shard.values()) / 16
    assert {s for s, _ in quotas_of(sized, shards=4)} == set(range(4))


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 20), ("1", 30)], "__k string, source_size long")
    targets, total = mixing.source_targets(sizes)
    # 1060 words at weights 1, 2, 3, 1: all but b are full at 30, 60 and 90, and b takes the rest.
    assert total == 1060 and {r["__k"]: r.target for r in targets.collect()} == {"0a": 30.0, "0b": 880.0, "0c": 60.0, "1": 90.0}


def test_mix_on_awkward_rows(awkward):
    rows = awkward.withColumn("__size", mixing.n_words(F.col("text")))
    got = mixing.mix(rows, ties=("__size",)).collect()
    mine = rows.select("doc_id", "source", "__size").collect()
    want = plain_mix([(r.source, r["__size"]) for r in mine], seeded_key([r.doc_id for r in mine], [r["__size"] for r in mine]))
    assert sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in got) == sorted((str(m.doc_id), str(m.source), m["__size"], want[i][0]) for i, m in enumerate(mine))
    whole = mixing.mixed_documents(awkward)
    assert whole.columns == awkward.columns and {r.doc_id for r in whole.collect()} <= {r.doc_id for r in mine if r["__size"]}


def test_mix_settles_small_sources(spark):
    big = [(i, f"big{i % 4}", 1_000_000) for i in range(100)]
    small = [(100, "tiny", 100), (102, "less", 60_000), (103, None, 1), (104, "none", 0)]
    df = spark.createDataFrame(big + small, "doc_id long, source string, __size long")
    got = mixing.mix(df).toPandas()
    by = got.groupby("source", dropna=False).agg(size=("source_size", "first"), t=("target", "first"), k=("taken", "sum"))
    assert by.t["tiny"] == 300 and by.k["tiny"] == 300 and by.k["less"] == 180_000 and got.taken[got.source.isna()].sum() == 3 and by.k["none"] == 0
    assert (abs(by.k - by.t) <= 0.01 * by.t).all() and (got.taken <= 3 * got["size"]).all()
    quotas, taken = quotas_of(df), Counter()
    for r in got.itertuples():
        for p in r.shards:
            taken[p["shard"], None if r.source is None or r.source != r.source else r.source] += p["words"]
    assert taken == quotas
    equal = spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit(50).cast("long").alias("__size"))
    sums = mixing.mix(equal, blocks=320).agg(F.sum("taken"), F.sum("target"), F.max(F.abs(F.col("taken") - F.col("target")))).first()
    assert sums[2] <= 0.5 and abs(sums[0] - sums[1]) <= 0.01 * sums[1]


def test_running_totals(spark):
    from folioframe.llm._common import running

    rows = [(f"{i * 7919 % 1000:04d}", i) for i in range(1000)]
    got = running(spark.createDataFrame(rows, "k string, n long").repartition(5), ["k"], {"before": "n"}).collect()
    at, want = 0, {}
    for row, (k, n) in enumerate(sorted(rows), 1):
        want[k], at = (row, at), at + n
    assert {r.k: (r["__row"], r.before) for r in got} == want


# --- chat, WARC, benchmark


def test_chat_round_trip_of_hostile_texts(spark):
    pieces = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "\n", " ", "x", "[", "]", "<<SYS>>", "/", "INST]", "\\[", "é", "\n</s>\n", "$1"]
    rng = random.Random(9)
    said = [(c, t, rng.choice(["user", "assistant", "system", "to\nol\\n", "[INST]", "\\\\n", None]), "".join(rng.choices(pieces, k=rng.randrange(12)))) for c in range(60) for t in range(5)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_chats(df)).collect():
        mine = [(role or "", text) for c, _, role, text in said if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == mine and r.loss_texts == [t for role, t in mine if role == "assistant"]


def test_chat_machine(spark):
    talk = lambda c, roles: [(c, i, r, "t") for i, r in enumerate(roles)]
    df = spark.createDataFrame(talk(1, ["system", "user", "assistant"]) + talk(2, ["user", "user", "assistant"]) + talk(3, ["user"]) + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_chats(df).collect()} == {1: (True, -1), 2: (False, 1), 3: (False, -1), None: (False, 0)}


def test_zip_directories():
    data = [("a.txt", b"hello"), (warc.DATA, b"x" * 1000), ("empty", b"")]
    import io
    import zipfile

    for raw in (warc.zip_stored(data), warc.zip_stored([])):
        zipfile.ZipFile(io.BytesIO(raw)).testzip()
    raw = b"junk"[:0] + warc.zip_stored(data)
    read = warc.ByRange(io.BytesIO(raw), len(raw))
    members = warc.directory(read)
    for name, body in data:
        assert read(warc.data_offset(read, members[name]), members[name].size) == body
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("s", b"stored")
        z.writestr("d", b"deflated" * 50, zipfile.ZIP_DEFLATED)
        z.comment = struct.pack("<I", warc.END) + b" in a comment"
    read = warc.ByRange(plain, len(plain.getvalue()))
    members = warc.directory(read)
    assert read(warc.data_offset(read, members["s"]), 6) == b"stored"
    with pytest.raises(ValueError):
        warc.data_offset(read, members["d"])
    for bad in (b"", b"no zip at all", raw[:-10]):
        with pytest.raises(ValueError):
            warc.directory(warc.ByRange(io.BytesIO(bad), len(bad)))


def test_warc_records_one_by_one():
    raw = warc.record(5, "http://x/\r\ny", b"\r\n\r\nbody\r\n", warc.digest(b"\r\n\r\nbody\r\n"), None, False)
    head, http, payload = warc.parse(raw)
    assert payload == b"\r\n\r\nbody\r\n" and head["warc-target-uri"] == "http://x/y" and http["content-length"] == "10"
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


def test_warc_of_awkward_pages(spark):
    rows = [(3, "u", None), (2, None, ""), (1, "u", "x"), (4, "u", "x"), (4, "u", "x"), (None, "u", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit("clash"))
    folder = warc.shared_dir(spark) + "/warc-test"
    made = warc.write_archives(warc.plan_records(df), folder, archive_bytes=200)
    assert made.count() >= 2
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(made, folder).collect())
    assert got == Counter([(2, 0, "response", None), (3, 0, "revisit", 2), (1, 1, "response", None), (4, 1, "revisit", 1), (4, 1, "revisit", 1), (None, 1, "response", None)])


def test_decontamination(spark, awkward):
    item = " ".join(f"q{i}" for i in range(30))
    words = item.split()
    near = " ".join(words[:28] + ["zz", "zz"])  # 24 of 26 shingles
    far = " ".join(words[:20])  # 16 of 26
    filler = " ".join(f"f{i}" for i in range(5000))
    df = spark.createDataFrame([(1, f"{filler} {item.upper()} {filler}"), (2, near), (3, far), (4, None), (5, ""), (None, item), (1, f"{filler} {item.upper()} {filler}")], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "three short words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(1, 10): 26, (2, 10): 24, (None, 10): 26}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, items).collect()) == [3, 4, 5]
    big, decontaminate.MAX_BROADCAST = decontaminate.MAX_BROADCAST, 0  # the way for tables too large to broadcast
    try:
        assert {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.contaminated(df, items).collect()} == got
    finally:
        decontaminate.MAX_BROADCAST = big
    assert decontaminate.decontaminate(awkward, items).count() == awkward.count()


def test_short_items_inside_long_documents(spark):
    filler = " ".join(f"f{i}" for i in range(50))
    df = spark.createDataFrame([(1, f"{filler} Who Was First {filler}"), (2, f"{filler} who was {filler} first"), (3, "who was first"), (4, f"{filler} only")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "who was first"), (11, "Only"), (12, None), (13, "who was it then")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(1, 10, 1, 1), (3, 10, 1, 1), (4, 11, 1, 1)}
    assert [r.doc_id for r in decontaminate.decontaminate(df, items).collect()] == [2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    path = public_tokenizers.path("word_bpe_49k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    made = [lines.line_quality(none), shards.interleave(none), mixing.mixed_documents(none), bpe.token_counts(none, path), simhash.simhash_components(none), simhash.simhash_dedup(none), rulefit.score(none, rulefit.fit(none, labels)), langid.identify(none, langid.fit(none)), decontaminate.contaminated(none, items), decontaminate.decontaminate(none, items), chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))]
    assert [df.count() for df in made] == [0] * len(made)


# --- plain versions of what is learned, bounds and archives of others


def slow_statistics(text):
    t = text or ""
    w, white = re.findall(r"[^\x20\x09-\x0D]+", t), sum(t.count(c) for c in " \t\n\x0b\x0c\r")
    lines_ = [x for x in t.split("\n") if x]
    letters, n = len(t) - white, len(w)
    per = lambda a, b: a / b if b else 0.0
    distinct = len(set(re.split(r"[\x20\x09-\x0D]+", t)))
    ended = len(re.findall(r"[.!?][\x20\x09\x0D]*(?:\n|\Z)", t))
    upper, digits = sum(unicodedata.category(c) == "Lu" for c in t), sum("0" <= c <= "9" for c in t)
    return [
        np.log1p(n), per(letters, n), per(len(re.findall(r"[#*$%&|<>]", t)), n), per(len(re.findall(r"[!?]{2,}", t)), n), per(upper, letters), per(digits, letters), per(distinct, n),
        per(ended, len(lines_)), per(len(re.findall(r"[ \t]\|[ \t]", t)), n), per(n, len(lines_)), per(t.count(","), n), 1 - len(set(lines_)) / len(lines_) if lines_ else 0.0,
    ]


def slow_score(model, x):
    z = model.intercept
    for rule, weight in model.rules:
        if all((x[s] > t) if up else (x[s] <= t) for s, up, t in rule):
            z += weight
    return 1 / (1 + math.exp(-z))


def test_quality_scores_against_a_plain_version(spark, docs, awkward):
    model = rulefit.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.rules
    for df in (docs, awkward.drop("score")):
        texts = Counter((r.doc_id, round(slow_score(model, slow_statistics(r.text)), 9)) for r in df.collect())
        scored = rulefit.score(df, model).collect()
        assert Counter((r.doc_id, round(r.score, 9)) for r in scored) == texts
        assert all(r.predicted == (r.score >= 0.3) for r in scored)


def slow_ngrams(text):
    """Counts of 1- to 3-grams by the module's hash of them."""
    low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text]
    s = re.sub(" +", " ", " " + "".join(low) + " ")
    mask, out = (1 << 64) - 1, Counter()
    for x, y, z in zip(s, s[1:], s[2:]):
        a, b, c = map(ord, (x, y, z))
        grams = [(a * 0x85EBCA77 + b) * 0x9E3779B1 + (1 << 40), ((a * 0x85EBCA77 + b) * 0xC2B2AE3D + c) * 0x9E3779B1 + (1 << 41)] + ([b * 0x9E3779B1] if y != " " else [])
        for h in grams:
            h &= mask
            out[((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> 50] += 1
    return out


def slow_language(model, text):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    grams = {g: (1 + math.log(n)) * model.idf[g] for g, n in slow_ngrams(text).items()}
    norm = math.sqrt(sum(w * w for w in grams.values()))
    cosines = [sum(w * c[g] for g, w in grams.items()) / norm for c in model.centroids]
    best = max(range(len(cosines)), key=cosines.__getitem__)
    bound = model.bounds[model.languages[best]]
    return model.languages[best], cosines[best], 1 - cosines[best] > bound + (1 - bound) / math.sqrt(1 + len(grams) / 40)


def test_languages_against_a_plain_version(spark, docs, awkward):
    model = langid.fit(docs)
    for df in (docs.limit(60), awkward.where("doc_id IS NULL OR doc_id <> 5")):
        for r in langid.identify(df, model, keep=["doc_id", "text"]).collect():
            lang, score, rejected = slow_language(model, r.text)
            assert (r.lang_pred, r.rejected) == (lang, rejected) and abs(r.score - min(1, score)) < 1e-5


def test_samples_hold_a_repeated_row_once(spark, docs):
    one = docs.where("lang IS NOT NULL AND pmod(crc32(cast(doc_id AS string)), 4) <> 2").limit(1)
    many = docs.unionByName(one.crossJoin(spark.range(500)).select(*docs.columns))
    rows = langid.fit(many)
    assert rows.languages == langid.fit(docs).languages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    tripled = docs.unionByName(docs).unionByName(docs)
    assert rulefit.fit(tripled, labels).rules == rulefit.fit(docs, labels).rules


def test_token_counts_on_awkward_rows(awkward):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in bpe.token_counts(awkward, path).collect())
    counter = bpe.Counter(bpe.load(path))
    assert got == Counter((r.doc_id, len((r.text or "").encode()), counter.count(r.text or "")) for r in awkward.collect())
    assert counter.count("x" * 100_000 + " abc") and max(map(len, counter)) < bpe.MEMO_LENGTH


def test_near_copies_on_awkward_rows(awkward):
    kept = simhash.simhash_dedup(awkward)
    assert kept.columns == awkward.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, None, 4, 5, 6, 7, 7, 9])


def test_sharded_documents_on_awkward_rows(awkward):
    got = shards.sharded_documents(awkward)
    rows = got.collect()
    assert set(awkward.columns) <= set(got.columns) and Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in awkward.collect())
    assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == crc(r.text) for r in rows)


def test_archives_of_others(spark):
    first, second = (warc.record(i, None, b"p%d" % i, warc.digest(b"p%d" % i), None, False) for i in (1, 2))
    index = lambda rows: "\n".join(rows).encode()
    two = warc.zip_stored([("archive/a.warc.gz", first), ("archive/b.warc.gz", b"??" + second), ("pages/x", b"no record"), ("indexes/all.cdx", index([f"0 {len(first)} 1 a.warc.gz", f"2 {len(second)} 2 b.warc.gz"]))])
    empty = warc.zip_stored([(warc.DATA, b""), (warc.INDEX, b"")])
    bare = warc.zip_stored([])
    folder = warc.shared_dir(spark) + "/warc-others"
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)

    def put(name, body):
        with fs.open_output_stream(f"{at}/{name}") as out:
            out.write(body)

    for name, body in (("two.zip", two), ("empty.zip", empty), ("bare.zip", bare)):
        put(name, body)
    read = lambda *names: warc.read_archives(spark.createDataFrame([(n,) for n in names], "archive string"), folder).collect()
    assert sorted(r.page_id for r in read("two.zip", "empty.zip", "bare.zip")) == [1, 2]
    import io

    for members in ([("archive/a.warc.gz", first), ("indexes/i", b""), ("archive/b.warc.gz", second)], [(warc.DATA, first), (warc.INDEX, b"0 9999 1")], [("archive/a.warc", first), ("archive/b.warc", second), ("indexes/i", b"0 5 1")]):
        raw = warc.zip_stored(members)
        with pytest.raises(ValueError):
            warc.entries(warc.ByRange(io.BytesIO(raw), len(raw)))


def test_no_pages_and_very_long_ones(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    folder = warc.shared_dir(spark) + "/warc-none"
    assert warc.read_archives(warc.write_archives(warc.plan_records(none), folder), folder).count() == 0
    long = "é<p>" * 1_000_000
    pages = spark.createDataFrame([(i, "u", long) for i in (5, 4)], none.schema)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(warc.plan_records(pages), folder), folder).collect()}
    assert got == {4: (5_000_000, "response", None), 5: (5_000_000, "revisit", 4)}


def test_sketches_estimate_containment(spark):
    words = [f"q{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [(i, " ".join(words[:n] + [f"z{i}x{k}" for k in range(100)])) for i, n in enumerate((60, 52, 40, 10))]
    keyed = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", " ").alias("w")).withColumn("n", F.size("w"))
    got = {r.doc_id: r.estimate for r in decontaminate.candidates(keyed, items.select("item_id", F.split("text", " ").alias("w")), []).collect()}
    assert got[0] == 1.0 and 0 in got and 1 in got and 3 not in got and all(0 < e <= 1 for e in got.values())


def test_checked_counts_rows_and_bytes(spark):
    from folioframe.llm._common import checked

    hinted = lambda df, *most: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() if (df := checked(df, *most)) else None
    df = spark.createDataFrame([("x" * 1000,)] * 3, "a string")
    assert hinted(df) and not hinted(df, 2) and not hinted(df, 10, 500)


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from folioframe.llm._common import shared_dir

    gone = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: gone)))
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=sc))
