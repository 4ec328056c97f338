"""Words of many texts at once: positions and 64-bit hashes, in numpy over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: ASCII white space; UTF-8 has these bytes nowhere else.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]

#: Bytes, or words, that are hashed at once: what is needed beside the result doesn't grow with the text.
CHUNK = 1 << 18


def _powers(base: int) -> np.ndarray:
    """base to the powers 0 to CHUNK."""
    grown = np.full(CHUNK + 1, base, np.uint64)
    grown[0] = 1
    return np.multiply.accumulate(grown)


_UP, _DOWN = _powers(int(_BASE)), _powers(int(_BASE_INVERSE))


@dataclass
class Words:
    """Words of a block of texts, in order. of: each word's text; first: where each text's words begin, and the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n words in a row of one text begin, and a hash of those words."""
        if len(self.hash) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.of[: len(self.of) - n + 1] == self.of[n - 1 :])
        return at, run_hash(self.hash, n)[at]


def run_hash(word_hash: np.ndarray, n: int) -> np.ndarray:
    """For each place where n words follow, a hash of those n words in order."""
    if n > CHUNK // 2:  # as many as that at one place only, in practice
        return np.concatenate([spans_hash(word_hash[i : i + n], np.array([0]), np.array([n])) for i in range(len(word_hash) - n + 1)] or [np.empty(0, np.uint64)])
    out = np.empty(max(0, len(word_hash) - n + 1), np.uint64)
    step = CHUNK - n + 1
    for i in range(0, len(out), step):
        some = word_hash[i : i + CHUNK]
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * _UP[: len(some)], out=sums[1:])
        got = (sums[n:] - sums[:-n]) * _DOWN[: len(some) - n + 1]
        out[i : i + len(got)] = mixed(got + np.uint64(n))
    return out


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each span of values (starts and ends in order), what run_hash() gives for that many."""
    return mixed(_spans(values, start, end) + (end - start).astype(np.uint64))


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """The sum of value times base to its place in the span, for spans with starts and ends in order. table: what a value stands for."""
    out = np.zeros(len(start), np.uint64)
    for i in range(0, len(values), CHUNK):
        some = values[i : i + CHUNK]
        low, high = np.searchsorted(end, i, "right"), np.searchsorted(start, i + len(some), "left")
        if low >= high:
            continue
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum((some if table is None else table[some]) * _UP[: len(some)], out=sums[1:])
        first, last = np.maximum(start[low:high] - i, 0), np.minimum(end[low:high] - i, len(some))
        part = (sums[last] - sums[first]) * _DOWN[first]
        for j in np.flatnonzero(start[low:high] < i):  # what goes on from the chunk before
            part[j : j + 1] *= np.uint64(pow(int(_BASE), int(i - start[low + j]), 2**64))
        out[low:high] += part
    return out


def words(texts: list[bytes], lower: bool = False) -> Words:
    """lower: hash A-Z as a-z."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts, ends, before = [], [], True
    for i in range(0, len(data), CHUNK):
        space = _SPACE[data[i : i + CHUNK]]
        edge = np.flatnonzero(np.diff(space, prepend=before)) + i
        starts.append(edge[~space[edge - i]])
        ends.append(edge[space[edge - i]])
        before = space[-1]
    none = np.empty(0, np.int64)
    start, end = np.concatenate([none, *starts]), np.concatenate([none, *ends])
    text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    first = np.concatenate([[0], np.searchsorted(start, text_end)])
    of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    hashed = mixed(_spans(data, start, end, _LOWER if lower else _BYTES) + (end - start).astype(np.uint64))
    return Words(data, start, end, of, first, hashed)


def blocks(keys: list, texts: Iterator[str | None], most_bytes: int = 1 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """keys and their texts' bytes (null: empty), in blocks of about most_bytes; a longer text is a block of its own."""
    some_keys, some, size = [], [], 0
    for key, text in zip(keys, texts, strict=True):
        raw = (text or "").encode()
        if some and size + len(raw) > most_bytes:
            yield some_keys, some
            some_keys, some, size = [], [], 0
        some_keys.append(key)
        some.append(raw)
        size += len(raw)
    if some:
        yield some_keys, some
