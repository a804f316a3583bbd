"""Distinct word n-grams of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from stratacart.llm.common import ASCII_SPACE, ASCII_UPPER

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A table of powers for less than a megabyte of text is kept; longer texts make their own.
_TABLE_BITS = 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte a random 64-bit number (a letter's is the same in either case) and whether it
    is white space; factors of the n-gram hash."""
    rng = np.random.default_rng(20_240_131)
    numbers = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for letter in ASCII_UPPER:
        numbers[ord(letter)] = numbers[ord(letter.lower())]
    space = np.zeros(256, dtype=bool)
    space[[ord(c) for c in ASCII_SPACE]] = True
    factors = rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return numbers, space, factors


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    return _kept_table() if n <= 1 << _TABLE_BITS else _power_table(n)


@lru_cache(maxsize=1)
def _kept_table() -> tuple[np.ndarray, np.ndarray]:
    return _power_table(1 << _TABLE_BITS)


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _ODD)
    up[0] = 1
    np.multiply.accumulate(up, out=up)
    down = np.full(size, np.uint64(pow(int(_ODD), -1, 1 << 64)))
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in turn, and for each text the place behind its last word."""
    numbers, space, _ = _tables()
    data = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", dtype=np.uint8)
    inside = ~space[data]
    turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = turns[0::2], turns[1::2]
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(numbers[data] * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashes, np.searchsorted(starts, text_ends)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text its distinct ``width``-word shingles as ascending hashes; with fewer words
    the whole sequence is the one shingle, without words there is none."""
    _, _, factors = _tables()
    words, stops = word_hashes(texts)
    runs = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for i in range(width):
        runs += words[i : i + len(runs)] * factors[i]
    runs = mixed(runs)
    out = []
    start = 0
    for stop in stops.tolist():
        count = stop - start
        if count >= width:
            own = np.sort(runs[start : stop - width + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            out.append(own)
        elif count:
            whole = (words[start:stop] * factors[:count]).sum(dtype=np.uint64)
            out.append(mixed(np.array([whole], dtype=np.uint64) + factors[32 + count]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        start = stop
    return out
