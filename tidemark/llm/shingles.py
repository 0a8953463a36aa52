"""Word shingles of whole texts, hashed in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of a shingle; bytes of texts that are hashed together (a longer text is hashed by itself).
WORDS, SLICE = 5, 1 << 17
PRIME, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: A random word for each byte; which bytes are ASCII white space.
BYTES = scrambled(np.arange(1, 257, dtype=np.uint64) * PRIME)
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
EMPTY = scrambled(np.array([PRIME]))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of PRIME and of its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
    return tuple(np.concatenate([[np.uint64(1)], np.full(n - 1, p, np.uint64)]).cumprod(dtype=np.uint64) for p in (PRIME, inverse))


POWERS = powers(SLICE)


def word_hashes(data: np.ndarray, offsets: np.ndarray, power: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of consecutive texts, the number of words before each text and after the last).

    data holds the texts' bytes, offsets where each begins and the last ends. A word is what stands between ASCII white space; its hash is a polynomial of its bytes,
    a difference of running sums.
    """
    held = ~BLANK[data]
    before = np.concatenate([[False], held[:-1]])
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(held & ~before)
    after = np.concatenate([held[1:], [False]])
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(held & ~after) + 1
    sums = np.concatenate([[np.uint64(0)], (BYTES[data] * power[0][: len(data)]).cumsum(dtype=np.uint64)])
    return scrambled((sums[ends] - sums[starts]) * power[1][starts]), np.searchsorted(starts, offsets)


def shingled(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes in order, how often each) of each text, a null being empty.

    A text of fewer than WORDS words is one shingle, one without words has the empty word.
    """
    at, raw = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64), texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        data, offsets = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        words, first = word_hashes(data, offsets, POWERS if len(data) <= SLICE else powers(len(data)))
        whole = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS if len(whole) else 0):
            whole = whole * PRIME + words[k : k + len(whole)]
        whole = scrambled(whole)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(whole[a : b - WORDS + 1], return_counts=True)
            else:
                h = np.zeros(1, np.uint64)
                for w in words[a:b] if b > a else EMPTY:
                    h = h * PRIME + w
                yield scrambled(h), np.ones(1, np.int64)
        i = j
