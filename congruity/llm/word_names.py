"""Names of words and of word sequences, many texts at a time.

A name is a hash of 64 bits under a key drawn for each run, so that every task gives
equal words and equal sequences one name without a lookup.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np

#: Longer words are digested by themselves; bytes hashed at once.
LONG_WORD, PORTION = 1 << 12, 1 << 20
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(4)
def tables(key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, a factor for each place in a word, factors of a sequence."""
    rng = np.random.default_rng(key)
    odd = lambda n: rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(256), odd(LONG_WORD), odd(64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def word_names(data: bytes, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts and ends of the words of ``data``, where one blank stands before,
    between and behind words."""
    buffer = np.frombuffer(data, np.uint8)
    blank = np.flatnonzero(buffer == 32)
    start, end = blank[:-1] + 1, blank[1:]
    size = end - start
    value, factor, _ = tables(key)
    names = np.zeros(len(start), np.uint64)
    long = np.flatnonzero(size > LONG_WORD)
    portions = np.searchsorted(end, np.arange(PORTION, len(buffer) + PORTION, PORTION)).tolist()
    first = 0
    for last in [*portions, len(start)]:
        if last > first:
            n = np.minimum(size[first:last], LONG_WORD)
            at = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(at, n)
            letters = buffer[np.repeat(start[first:last], n) + place]
            names[first:last] = np.add.reduceat(value[letters] * factor[place], at)
            first = last
    for k in long.tolist():
        names[k] = int.from_bytes(blake2b(data[start[k] : end[k]], digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return mixed(names + size.astype(np.uint64)), start, end


def sequence_names(names: np.ndarray, n: int, key: int, turn: int = 0) -> np.ndarray:
    """Names of every ``n`` neighbours; ``turn`` gives independent ones."""
    out = np.zeros(max(len(names) - n + 1, 0), np.uint64)
    for k in range(n if len(out) else 0):
        out += names[k : k + len(out)] * tables(key + turn)[2][k % 64] + np.uint64(k // 64)
    return mixed(out)
