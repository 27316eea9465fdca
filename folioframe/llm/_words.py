"""Words and word shingles of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64
BLOCK_BYTES = 1 << 20
LONGEST = 512  # longer spans go through the xxhash library one by one


@dataclass
class Words:
    """Words of a block of texts. ``buf`` has them joined by single spaces, padded at its end."""

    buf: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes in all (at least one text), with the number of the first."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= limit:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def words_of(texts: list[bytes]) -> Words:
    """Splits each text at runs of ASCII white space."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[0] = not space[0]
    buf = raw[keep]
    buf = np.where(space[keep], np.uint8(32), buf)
    end = np.flatnonzero(buf == 32)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else np.zeros(0, np.int64)
    text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], text_end])]
    return Words(buf.tobytes() + b"\0" * 8, start, end, np.searchsorted(start, kept))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of every run of ``size`` words inside one text (all its words if it has fewer), and the
    number of such runs before each text (one more entry at the end)."""
    n = np.diff(w.first)
    runs = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    before = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(n)), runs)
    word = w.first[text] + np.arange(before[-1]) - before[text]
    last = np.minimum(word + size - 1, w.first[text + 1] - 1)
    return (w.start[word], w.end[last], before) if len(word) else (np.zeros(0, np.int64), np.zeros(0, np.int64), before)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _equal_length(buf: bytes, start: np.ndarray, length: int, seed: int) -> np.ndarray:
    size = len(buf)
    eight = np.ndarray((size - 7,), "<u8", buf, strides=(1,))
    four = np.ndarray((size - 3,), "<u4", buf, strides=(1,))
    one = np.frombuffer(buf, np.uint8)
    s, at = np.uint64(seed), 0
    with np.errstate(over="ignore"):
        if length >= 32:
            v = [np.full(len(start), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            while at + 32 <= length:
                v = [_round(v[k], eight[start + at + 8 * k]) for k in range(4)]
                at += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros_like(x), x)) * P1 + P4
        else:
            h = np.full(len(start), s + P5, np.uint64)
        h += np.uint64(length)
        while at + 8 <= length:
            h = _rotl(h ^ _round(np.uint64(0), eight[start + at]), 27) * P1 + P4
            at += 8
        if at + 4 <= length:
            h = _rotl(h ^ four[start + at].astype(np.uint64) * P1, 23) * P2 + P3
            at += 4
        while at < length:
            h = _rotl(h ^ one[start + at].astype(np.uint64) * P5, 11) * P1
            at += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def xxh64(buf: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each buf[start:end]; buf must reach 8 bytes beyond the last end."""
    import xxhash

    length = end - start
    out = np.empty(len(start), np.uint64)
    order = np.argsort(np.minimum(length, LONGEST + 1).astype(np.uint16), kind="stable")
    sorted_len = np.minimum(length[order], LONGEST + 1)
    cuts = np.flatnonzero(np.diff(sorted_len)) + 1
    for group in np.split(order, cuts) if len(order) else []:
        n = int(length[group[0]])
        if n > LONGEST:
            for i in group.tolist():
                out[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]], seed)
            continue
        for k in range(0, len(group), 1 << 14):
            part = group[k : k + (1 << 14)]
            out[part] = _equal_length(buf, start[part], n, seed)
    return out
