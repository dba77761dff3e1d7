"""Sets of word shingles as sorted arrays of 64-bit hashes, built in numpy over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE, _A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def _powers(n: int, cache: list[np.ndarray] = [np.ones(1, _U)]) -> np.ndarray:  # noqa: B006
    while len(cache[0]) < n:
        cache[0] = np.concatenate([cache[0], cache[0] * (cache[0][-1:] * _BASE)])
    return cache[0]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, A-Z lower-cased, and the number of words up to each text's end.

    ``data`` holds the texts' UTF-8 bytes one after another, ``ends`` where each stops.
    """
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = ends[:-1]
    begins = begins[begins < len(data)]
    first[begins] = solid[begins]  # a text's first word does not go on from the text before
    at = np.flatnonzero(solid)
    starts = np.flatnonzero(first[at])
    counts = np.searchsorted(at[starts], ends) if len(starts) else np.zeros(len(ends), np.int64)
    if not len(starts):
        return np.zeros(0, _U), counts
    lengths = np.diff(starts, append=len(at))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    values = (_LOWER[data[at]].astype(_U) + _U(1)) * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, starts) + lengths.astype(_U) * _B), counts


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    A text of fewer words is one shingle, all of it; a null text or one without words has none.
    """
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    factors = [(mix(np.array([i + 1], _U) * _BASE) | _U(1))[0] for i in range(width)]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, len(texts))
        hashes, counts = word_hashes(body[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i])
        if len(hashes) >= width:
            rolled = sum(hashes[k : len(hashes) - width + 1 + k] * factors[k] for k in range(width))
            rolled = mix(rolled)
        else:
            rolled = np.zeros(0, _U)
        before = 0
        for end in counts.tolist():
            n = end - before
            if n >= width:
                found = np.sort(rolled[before : end - width + 1])
                keep = np.ones(len(found), bool)
                keep[1:] = found[1:] != found[:-1]
                yield found[keep]
            elif n:
                total = np.array([n], _U)
                for k in range(n):
                    total = mix(total + hashes[before + k : before + k + 1] * factors[k])
                yield total
            else:
                yield np.zeros(0, _U)
            before = end
        i = j
