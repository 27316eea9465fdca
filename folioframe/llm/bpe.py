"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made.

The tokenizer file names the steps: special strings are cut out of the raw text (one token each), the rest is
normalised (NFC, white space, lower case), cut into pieces by a pattern, and each piece's bytes are merged. A
piece's count is its number of bytes less the number of merges.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

LIMIT = 2048
MEMO = 400_000  # strings whose counts a Python worker remembers; more only cost time
MEMO_LENGTH = 64  # longer strings are counted anew each time


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load(path: str) -> dict:
    """What counting needs of a tokenizer file: merge ranks, end-of-word suffix, pattern and special strings.

    Only files of the kind that this module counts exactly are taken (NFC, white space, lower case; one pattern;
    bytes; a BPE model without dropout)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, steps = spec["model"], spec["normalizer"]["normalizers"]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    kinds = [s["type"] for s in steps], split["type"], split["behavior"], split["invert"], level["type"], level["use_regex"], model["type"]
    if kinds != (["NFC", "Replace", "Lowercase"], "Split", "Removed", True, "ByteLevel", False, "BPE") or model.get("dropout") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: not a word-level byte-pair file of the supported kind")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"ranks": {m: i for i, m in enumerate(merges)}, "suffix": model.get("end_of_word_suffix") or "", "pattern": split["pattern"]["Regex"], "special": [t["content"] for t in spec["added_tokens"]]}


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left after merging: pop the lowest-ranked pair (leftmost on ties) until none is known."""
    n = len(symbols)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], alive[j], right[i] = a + b, False, right[j]
        if right[j] < n:
            left[right[j]] = i
        merges += 1
        for p, q in ((left[i], i), (i, right[i])):
            if p >= 0 and q < n and (r := ranks.get((symbols[p], symbols[q]))) is not None:
                heapq.heappush(heap, (r, p, symbols[p], symbols[q]))
    return n - merges


class Counter(dict):
    """Counts of strings free of ASCII white space, remembered; ``count`` gives a whole text's tokens."""

    def __init__(self, spec: dict):
        import regex

        super().__init__()
        self.ranks, self.suffix, self.letters = spec["ranks"], spec["suffix"], byte_alphabet()
        self.pieces = regex.compile(spec["pattern"])
        self.special = regex.compile("|".join(map(regex.escape, spec["special"]))) if spec["special"] else None
        self.of_piece: dict[str, int] = {}

    def __missing__(self, chunk: str) -> int:
        parts = self.special.split(chunk) if self.special else [chunk]
        total = len(parts) - 1 + sum(map(self._plain, parts))
        if len(chunk) < MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = total
        return total

    def _plain(self, part: str) -> int:
        part = unicodedata.normalize("NFC", part)
        low = "".join(c.lower() for c in part) if "Σ" in part else part.lower()  # one by one: no final sigma
        return sum(map(self._piece, self.pieces.findall(low)))

    def _piece(self, piece: str) -> int:
        known = self.of_piece.get(piece)
        if known is None:
            symbols = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
            symbols[-1] += self.suffix
            known = merged_length(symbols, self.ranks)
            if len(self.of_piece) >= MEMO:
                self.of_piece.clear()
            if len(piece) < MEMO_LENGTH:
                self.of_piece[piece] = known
        return known

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, filter(None, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. A null text is empty: no bytes, no tokens.

    The file at ``path`` is read by the driver; its merges (a fixed table of the tokenizer, some MB) are broadcast.
    Repeated rows count each; an empty table gives no rows; only doc_id and text are read, so names cannot clash.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """token_counts of all documents: null texts count as empty, repeated rows count each."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
