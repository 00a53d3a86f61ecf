"""Vectorised word and shingle hashes over UTF-8 text: numpy inside a task, chunked so that memory stays bounded."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240501)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
CHUNK = 1 << 20

with np.errstate(over="ignore"):
    _POWERS = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(CHUNK + 4096, _P, np.uint64))])
    _INVERSE = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(CHUNK + 4096, pow(_P, -1, 1 << 64), np.uint64))])


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n < len(_POWERS):
        return _POWERS[: n + 1], _INVERSE[: n + 1]
    one = np.ones(1, np.uint64)
    return np.concatenate([one, np.multiply.accumulate(np.full(n, _P, np.uint64))]), np.concatenate([one, np.multiply.accumulate(np.full(n, pow(_P, -1, 1 << 64), np.uint64))])


def _hash_chunk(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of its first byte); no word crosses one of the cuts."""
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[cuts] = True
    edge[0] = edge[-1] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _powers(len(raw))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * power[: len(raw)], dtype=np.uint64)])
    own = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(own + (ends - starts).astype(np.uint64) * np.uint64(_Q)), starts


def word_hashes(data: bytes | memoryview | np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds): the words of text i are hashes[bounds[i]:bounds[i+1]].

    A word is a longest run without ASCII white space, A-Z lower-cased. Long texts are cut at white space.
    """
    raw = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    offsets = np.asarray(offsets, np.int64)
    hashes, places, at, end = [], [], int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(end, at + CHUNK)
        if stop < end:
            back = raw[at:stop]
            last = np.flatnonzero(_SPACE[back[-4096:]])
            if len(last):
                stop = stop - min(4096, len(back)) + int(last[-1]) + 1
            else:  # a word longer than what was looked at: go on to its end
                while stop < end and not _SPACE[raw[stop]]:
                    stop += 1
        cuts = offsets[(offsets >= at) & (offsets <= stop)] - at
        found, starts = _hash_chunk(raw[at:stop], cuts)
        hashes.append(found)
        places.append(starts + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes; fewer than ``width`` words make one shingle; no words make none."""
    n = len(hashes)
    rolled = np.zeros(0, np.uint64)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            rolled = rolled * np.uint64(_P) + hashes[j : n - width + 1 + j]
        rolled = mix64(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            total = np.array([b - a], np.uint64)
            for x in range(a, b):
                total = mix64(total * np.uint64(_Q) + hashes[x : x + 1])
            out.append(total)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_slices(column, most: int = 2 << 20):
    """(first row, bytes, offsets) slices of an Arrow string column of about ``most`` bytes; null texts are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, len(column))
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
