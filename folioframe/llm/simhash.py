"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect Golay code (23, 12, 7)
decodes any 23-bit word to the one codeword at distance 3 or less; the codeword's 12 data bits are an
index of the word's neighbourhood. ``fuzzy_indices`` gives the indices of a word and of all words at
distance 1 (one index if the word lies within distance 2 of its codeword, else six): the index of any
word at distance 1 or less is among them.

Up to three differing bits fall on three segments in one of three ways, and each has its keys:

* two segments are equal: their exact values are the key (3 keys a fingerprint);
* one segment is equal, the second differs in 1 bit, the third in 1 or 2: the equal segment's value with the Golay
  index of the segment that differs in one bit, and its parity flipped (6 keys stored, about 32 probed);
* all three differ in one bit: Golay indices of all three with the three parities flipped. One side gives the
  neighbourhood of the first segment, the other those of the second and third (about 28 stored, 5 probed).

So every pair within three bits shares a key; a join on keys finds it and ``bit_count(a ^ b) <= 3`` verifies it.

Near copies with other words in places lie farther apart than three bits of a fingerprint of shingles. ``NEAR_COPIES``
looks for them by a fingerprint of single words, weighted by length and by the root of their number, within six bits,
and verifies them by a fingerprint of five-word shingles within 14 bits: a Jaccard similarity of 0.8 is a cosine of
0.89, so 64 bits differ in 9.7 on average. Its keys come from four segments of 16 bits. With errors e1 <= e2 <= e3 <= e4
of six in all, either e1 = 0 and e2 <= 1, or e1 = 0 and the rest are 2 each, or e1 = e2 = 1:

* one segment is equal, another differs in at most 1 bit: the equal one's value with the Golay index of the other
  (12 keys stored, a neighbourhood of each probed);
* one segment is equal, all others differ in 2 bits: the equal one's value with the indices of the neighbourhood of the
  next segment, on both sides;
* two segments differ in one bit each: the index of one with the neighbourhood of the other on one side, the other way
  round on the other side.

Equal fingerprints are merged before any key is made. Each probed key is first joined with no more than the smallest and
the largest node that is stored under it, and near ones are tied; ties become labels by distributed hooking. Keys with
more nodes than these two are then joined in full, but only pairs of different labels are given out. So no link is
lost, and a cluster of copies costs a few ties a member and no pair for each two of its members: of its ties under
such crowded keys a node keeps two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checked, cut_lineage, remove, stored, table
from ._words import blocks, shingles, words_of, xxh64

SEED = 42
SHINGLE = 3
MAX_BITS = 3
NEAR_SHINGLE = 5
WORD_BYTES = 16  # a longer word weighs no more
FEW = 200_000  # pairs that one task hooks; of more, tasks first make forests
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the Golay code
SEGMENTS = ((41, 23), (18, 23), (0, 18))  # (shift, width), high to low


def _remainder(words: np.ndarray) -> np.ndarray:
    """The 11-bit syndrome: the word's polynomial modulo the generator."""
    words = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        words ^= ((words >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11))
    return words


def _leaders() -> np.ndarray:
    """For each syndrome the only error pattern of weight 3 or less that has it."""
    bits = 1 << np.arange(23, dtype=np.uint32)
    errors = [np.zeros(1, np.uint32), bits]
    i, j = np.triu_indices(23, 1)
    errors.append(bits[i] | bits[j])
    a, b, c = (x.ravel() for x in np.meshgrid(*[np.arange(23)] * 3, indexing="ij"))
    up = (a < b) & (b < c)
    errors.append(bits[a[up]] | bits[b[up]] | bits[c[up]])
    every = np.concatenate(errors).astype(np.uint32)
    out = np.zeros(2048, np.uint32)
    out[_remainder(every)] = every
    return out


_LEADERS: np.ndarray | None = None


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12 data bits of the codeword nearest to each 23-bit word."""
    global _LEADERS
    if _LEADERS is None:
        _LEADERS = _leaders()
    words = words.astype(np.uint32)
    return (words ^ _LEADERS[_remainder(words)]) >> np.uint32(11)


def fuzzy_indices(words: np.ndarray, width: int = 23) -> np.ndarray:
    """Indices of all words at distance exactly 1 within the width: one row a word, width columns."""
    flips = (np.uint32(1) << np.arange(width, dtype=np.uint32))[None, :]
    return golay_index((words.astype(np.uint32)[:, None] ^ flips).ravel()).reshape(len(words), width)


def _majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have set; bytes of eight bit counters are summed 255 rows at a time."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 255 << 8):
        bits = np.unpackbits(hashes[k : k + (255 << 8)].astype(">u8").view(np.uint8)).view(np.uint64)
        if pad := -len(bits) // 8 % 255:
            bits = np.concatenate([bits, np.zeros(8 * pad, np.uint64)])
        ones += bits.reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints_of(texts: list[str | None]) -> list[int]:
    """SimHash of the 3-word shingles of each text with A-Z in lower case, repeats counted; no word: 0."""
    out: list[int] = []
    for _, block in blocks([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        w = words_of([t.lower() for t in block])  # of bytes: A-Z only
        start, end, before = shingles(w, SHINGLE)
        hashes = xxh64(w.buf, start, end, SEED)
        out += [_signed(_majority(hashes[a:b])) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _weighted(hashes: np.ndarray, weights: np.ndarray) -> int:
    """The 64 bits that hashes of more than half the weight have set; weights are whole numbers, so sums are exact."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += weights[k : k + (1 << 14)] @ bits.astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > weights.sum()).tobytes(), "big")


def profiles_of(texts: list[str | None]) -> tuple[list[int], list[int]]:
    """Of each text with A-Z in lower case, the SimHash of its words and that of its five-word shingles, repeats counted.

    A word weighs 16 * sqrt(its number) * its bytes (WORD_BYTES at most), rounded down."""
    fp, five = [], []
    for _, block in blocks([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        w = words_of([t.lower() for t in block])
        hashes = xxh64(w.buf, w.start, w.end, SEED)
        size = np.minimum(w.end - w.start, WORD_BYTES)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            own, at, count = np.unique(hashes[a:b], return_index=True, return_counts=True)
            fp.append(_signed(_weighted(own, np.floor(16 * np.sqrt(count) * size[a:b][at]).astype(np.int64))))
        start, end, before = shingles(w, NEAR_SHINGLE)
        long = xxh64(w.buf, start, end, SEED)
        five += [_signed(_majority(long[a:b])) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
    return fp, five


def _mapped(docs: DataFrame, of: Callable[[list], tuple[list[int], ...]], columns: tuple[str, ...], text: str, keep: tuple[str, ...]) -> DataFrame:
    keep_names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(x, pa.int64()) for x in of(batch.column("__text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep_names] + made, [*keep_names, *columns])

    src = docs.select(*keep_names, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep_names)
    return src.mapInArrow(run, ", ".join([schema, *(f"{c} long" for c in columns)]))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp`` (long, the 64 bits as a signed number) of each row. A null text has no word."""
    return _mapped(docs, lambda texts: (fingerprints_of(texts),), ("fp",), text, keep)


def profiles(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``fp`` (of words) and ``five`` (of five-word shingles) of each row. A null text has no word."""
    return _mapped(docs, profiles_of, ("fp", "five"), text, keep)


def _distinct(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the distinct indices of each row."""
    rows = np.repeat(np.arange(len(near), dtype=np.int64), near.shape[1])
    both = np.unique(rows << 12 | near.ravel().astype(np.int64))
    return both >> 12, both & 4095


def _product(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, ...]:
    """All combinations of a row's left and right indices: (row, left, right)."""
    counts = np.bincount(right[0], minlength=n)
    first = np.cumsum(counts) - counts
    times = counts[left[0]]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(left[0], times), np.repeat(left[1], times), right[1][np.repeat(first[left[0]], times) + within]


def join_keys(fp: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """The stored (or probed) keys of fingerprints, as (key, row). Any two fingerprints at most 3 bits apart have a
    stored key of either among the probed keys of the other. A key's high bits say its kind."""
    u, n = fp.view(np.uint64), len(fp)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.uint32) for s, w in SEGMENTS]
    wide = [s.astype(np.int64) for s in seg]
    parity = [(np.bitwise_count(s) & 1).astype(np.int64) for s in seg]
    index = [golay_index(s).astype(np.int64) for s in seg]
    near = [_distinct(fuzzy_indices(s, w)) for s, (_, w) in zip(seg, SEGMENTS)]
    own, out, kind = np.arange(n, dtype=np.int64), [], 0

    def put(key: np.ndarray, row: np.ndarray) -> None:
        nonlocal kind
        out.append((key | np.int64(kind << 48), row))
        kind += 1

    for a, b in ((0, 1), (0, 2), (1, 2)):  # two equal segments
        put(wide[a] << 23 | wide[b], own)
    for a, b in ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)):  # a equal, b one bit off
        if probe:
            row, idx = near[b]
            put(wide[a][row] << 13 | (parity[b][row] ^ 1) << 12 | idx, row)
        else:
            put(wide[a] << 13 | parity[b] << 12 | index[b], own)
    bits = parity[0] << 2 | parity[1] << 1 | parity[2]
    if probe:  # one bit off in each: the first segment's neighbourhood is probed, those of the others are stored
        row, idx = near[0]
        put(idx << 27 | index[1][row] << 15 | index[2][row] << 3 | (bits[row] ^ 7), row)
    else:
        row, one, two = _product(near[1], near[2], n)
        put(index[0][row] << 27 | one << 15 | two << 3 | bits[row], row)
    return np.concatenate([k for k, _ in out]), np.concatenate([r for _, r in out])


def near_keys(fp: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """As join_keys, for fingerprints at most 6 bits apart, from four segments of 16 bits."""
    u, n = fp.view(np.uint64), len(fp)
    seg = [((u >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.uint32) for s in (48, 32, 16, 0)]
    wide = [s.astype(np.int64) for s in seg]
    index = [golay_index(s).astype(np.int64) for s in seg]
    near = [_distinct(np.column_stack([fuzzy_indices(s, 16), i])) for s, i in zip(seg, index)]  # the word's own as well
    own, out, kind = np.arange(n, dtype=np.int64), [], 0

    def put(key: np.ndarray, row: np.ndarray) -> None:
        nonlocal kind
        out.append((key | np.int64(kind << 48), row))
        kind += 1

    for a in range(4):  # a equal, b at most one bit off
        for b in range(4):
            if b == (a + 1) % 4:  # both neighbourhoods: at most two bits off
                put(wide[a][near[b][0]] << 12 | near[b][1], near[b][0])
            elif b != a and probe:
                put(wide[a][near[b][0]] << 12 | near[b][1], near[b][0])
            elif b != a:
                put(wide[a] << 12 | index[b], own)
    for a in range(4):  # a and b one bit off each
        for b in range(a + 1, 4):
            x, y = (a, b) if probe else (b, a)
            row, idx = near[x]
            put((idx << 12 | index[y][row]) if probe else (index[y][row] << 12 | idx), row)
    return np.concatenate([k for k, _ in out]), np.concatenate([r for _, r in out])


@dataclass(frozen=True)
class Scheme:
    """Which nodes are near: each of ``columns`` differs in at most so many ``bits``. ``keys`` gives the stored and the
    probed keys of the first column."""

    columns: tuple[str, ...]
    bits: tuple[int, ...]
    keys: Callable[[np.ndarray, bool], tuple[np.ndarray, np.ndarray]]

    def node(self, prefix: str = "") -> Column:
        made = [F.col(prefix + c) for c in self.columns]
        return made[0] if len(made) == 1 else F.struct(*[m.alias(c) for m, c in zip(made, self.columns)])

    def near(self, a: str, b: str) -> Column:
        return reduce(Column.__and__, [F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) <= n for c, n in zip(self.columns, self.bits)])

    def named(self, prefix: str) -> list[Column]:
        return [F.col(c).alias(prefix + c) for c in self.columns]


THREE_BITS = Scheme(("fp",), (MAX_BITS,), join_keys)
NEAR_COPIES = Scheme(("fp", "five"), (6, 14), near_keys)


def _keyed(nodes: DataFrame, probe: bool, scheme: Scheme) -> DataFrame:
    keys = scheme.keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                key, row = keys(part.column("fp").to_numpy(zero_copy_only=False), probe)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key), *taken.columns], ["key", *taken.schema.names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(run, f"key long, {fields}")


#: Keys (with n nodes, lo and hi their least and largest fingerprint) under which more may be stored than ``ties`` compares.
CROWDED = "(n > 2 OR (n = 2 AND lo = hi))"


def ties(nodes: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame, str]:
    """(a, b): each node a with the smallest and the largest node stored under each of its probed keys that are near; the
    crowded keys (key), under which there may be others; and the path of the written table that both are read from.

    Of its ties under crowded keys, which are joined in full later, a node keeps its smallest and its largest. Both come
    from one table, so stored keys are dealt once. Runs a job when called."""
    fp, *rest = scheme.columns
    ends = [x for p, least, by in (("f_", F.min, F.min_by), ("l_", F.max, F.max_by)) for x in (least(fp).alias(p + fp), *[by(c, fp).alias(p + c) for c in rest])]
    held = (F.count(F.lit(1)).alias("n"), F.min(fp).alias("lo"), F.max(fp).alias("hi"))
    ended = _keyed(nodes, False, scheme).groupBy("key").agg(*ends, *held).withColumn("crowd", F.expr(CROWDED))
    probed = _keyed(nodes, True, scheme).select(F.col("key").alias("a_key"), *scheme.named("a_"))
    tied = lambda p: scheme.near("a_", p) & (scheme.node("a_") != scheme.node(p))
    met = probed.join(ended, (F.col("a_key") == F.col("key")) & (tied("f_") | tied("l_")))
    each = F.array(*[F.when(tied(p), scheme.node(p)) for p in ("f_", "l_")])
    found = met.select(scheme.node("a_").alias("a"), F.explode(each).alias("b"), "crowd", F.lit(None).cast("long").alias("key")).where("b IS NOT NULL")
    none = F.lit(None).cast(found.schema["a"].dataType)
    both, path = stored(found.unionByName(ended.where("crowd").select(none.alias("a"), none.alias("b"), "crowd", "key")))
    tied_ = both.where("key IS NULL")
    kept = tied_.where("crowd").groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most"))
    pairs = tied_.where("NOT crowd").select("a", "b").unionByName(kept.select("a", F.explode(F.array("least", "most")).alias("b")))
    return pairs.distinct(), both.where("key IS NOT NULL").select("key"), path


def links(nodes: DataFrame, scheme: Scheme = THREE_BITS, only: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of the distinct nodes that are near, each once; ``only`` limits them to those of a key in it. With a
    column ``label`` only pairs of nodes whose labels differ (null: a label of its own), and their labels la and lb."""
    extra = [c for c in ("label",) if c in nodes.columns]

    def side(p: str, probe: bool) -> DataFrame:
        keyed = _keyed(nodes.select(*scheme.columns, *extra), probe, scheme)
        keyed = keyed if only is None else keyed.join(only, "key", "left_semi")
        return keyed.select(F.col("key").alias(p + "key"), *scheme.named(p), *[F.col(c).alias("l" + p[0]) for c in extra])

    apart = F.coalesce(F.col("la") != F.col("lb"), F.lit(True)) if extra else F.lit(True)
    joined = side("a_", True).join(side("b_", False), (F.col("a_key") == F.col("b_key")) & (scheme.node("a_") < scheme.node("b_")) & scheme.near("a_", "b_") & apart)
    return joined.select(scheme.node("a_").alias("a"), scheme.node("b_").alias("b"), *(["la", "lb"] if extra else [])).distinct()


def _least(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of each of the nodes 0 to n - 1 the least of its component under the pairs (u, v)."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up
    return label


def _hooked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs (a, b) of a task to (node, label), as ``hook``."""
    got = list(batches)
    if not got:
        return
    ends = pa.concat_arrays([batch.column(c) for c in ("a", "b") for batch in got])
    got.clear()
    values = [x.to_numpy(zero_copy_only=False) for x in (ends.flatten() if pa.types.is_struct(ends.type) else [ends])]
    order = np.lexsort(values[::-1])
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([np.diff(x[order]) != 0 for x in values], axis=0)
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(fresh) - 1
    nodes = ends.take(pa.array(order[fresh]))
    label = _least(*index.reshape(2, -1), len(nodes))
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["node", "label"])


def hook(edges: DataFrame) -> tuple[DataFrame, str]:
    """Connected components of the pairs (a, b), a <> b: every node with the smallest node of its component (node, label),
    and the path of the written table that holds them.

    FEW pairs at most are hooked in one task and one job: rounds of jobs fill the driver's memory with their plans. Of
    more pairs, tasks of some 2 * FEW each keep a spanning forest, for as long as that leaves fewer pairs to hook. What
    remains too many is hooked over the cluster: each round takes the smallest neighbouring label, passes it to the old
    label's node and follows the new label one step, so the rounds grow with the logarithm of the longest chain. Labels
    are written after each round, and those of the round before are deleted.
    """
    spark, kind = edges.sparkSession, edges.schema["a"].dataType.simpleString()
    n, before = edges.count(), None
    while True:
        tasks = 1 if n <= FEW else -(-n // max(1, 2 * FEW))
        labels, forest = stored(edges.select("a", "b").coalesce(tasks).mapInArrow(_hooked, f"node {kind}, label {kind}"))
        if before:
            remove(spark, before)
        if tasks == 1:
            return labels, forest
        edges, before = labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")), forest
        n, were = edges.count(), n
        if n > 0.7 * were:
            break
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, path = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        sent = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        best = labels.unionByName(sent).groupBy("node").agg(F.min("label").alias("best"))
        both_known = labels.join(best, "node").select("node", F.col("label").alias("old"), "best")
        up = both_known.select(F.col("old").alias("node"), F.col("best").alias("label"), F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        passed = both_known.select("node", F.col("best").alias("label"), F.col("old").alias("was")).unionByName(up)
        now = passed.groupBy("node").agg(F.min("label").alias("label"), F.min("was").alias("was"))
        step = now.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after, now_at = stored(now.join(step, "label").select("node", F.least("label", "next").alias("label"), "was"))
        remove(spark, path)
        labels, path = after.select("node", "label"), now_at
        if after.where(F.col("label") != F.col("was")).isEmpty():
            remove(spark, forest)
            return labels, path


def components(fps: DataFrame, by: str, scheme: Scheme = THREE_BITS) -> DataFrame:
    """``fps`` (with the scheme's columns and ``by``) plus ``component``: the smallest ``by`` reachable over links, itself
    included. No link between different nodes is left out: those that are not given out join nodes of one label.

    fps is read several times, so it should be a written table (see ``cut_lineage``). Runs jobs when called.
    """
    names = list(scheme.columns)
    spark = fps.sparkSession
    nodes = cut_lineage(fps.groupBy(*names).agg(F.min(by).alias("least_id")).withColumn("node", scheme.node()))
    pairs, crowded, ties_at = ties(nodes.select(*names), scheme)
    tied, tied_at = stored(pairs)
    labelled, done = nodes.withColumn("label", F.lit(None).cast(nodes.schema["node"].dataType)), [ties_at, tied_at]
    if not tied.isEmpty():
        labels, labels_at = hook(tied)
        labelled, done = nodes.join(labels, "node", "left"), [*done, labels_at]
    labelled, _ = stored(labelled)
    edges, edges_at = stored(links(labelled, scheme, checked(crowded)).select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct())
    for path in done:
        remove(spark, path)
    whole = labelled.withColumn("label", F.coalesce("label", "node"))
    if not edges.isEmpty():
        top = hook(edges)[0].select(F.col("node").alias("label"), F.col("label").alias("top"))
        whole = whole.join(top, "label", "left").withColumn("label", F.coalesce("top", "label"))
    remove(spark, edges_at)
    least = whole.groupBy("label").agg(F.min("least_id").alias("component"))
    return fps.join(whole.select(*names, "label").join(least, "label").select(*names, "component"), names)


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row.

    Null and blank texts have fingerprint zero and link like any other. Rows that repeat a doc_id are rows of
    their own. Null ids are never the smallest id of a component unless it has no other (then null). An empty
    table gives no rows; other columns, whatever their names, are left out.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = cut_lineage(fingerprints(named))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return components(fps, "doc_id").select("doc_id", hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near copies (``NEAR_COPIES``) with all its columns: that of the smallest doc_id (nulls
    last), then of the smallest text hash. Exact repeats of that row are dropped as well.

    Null and blank texts are copies of each other. An empty table gives no rows; other columns may have any names. Runs
    jobs when called.
    """
    ident = [F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__th")]
    fps = cut_lineage(profiles(docs.select(*ident, F.col(text).alias("text")), keep=("__id", "__th")))
    ranked = fps.select("fp", "five", F.struct(F.col("__id").isNull().alias("none"), "__id", "__th").alias("rep"))
    stay = components(ranked, "rep", NEAR_COPIES).select("component").distinct().select("component.__id", "component.__th")
    marked = docs.select(*ident, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all"))
    found = marked.join(stay, marked["__id"].eqNullSafe(stay["__id"]) & (marked["__th"] == stay["__th"]), "left_semi")
    return found.dropDuplicates(["__id", "__th"]).select("__all.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """simhash_components over all documents: its rules for null, blank and repeated rows and empty tables hold."""
    return simhash_components(table(spark, sf_dir, "documents"))
