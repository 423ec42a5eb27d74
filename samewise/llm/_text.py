"""Texts as numpy arrays of code points: words, their hashes, and rolling hashes over them.

All hashes are polynomials modulo 2**64 over random-looking 64-bit values. With an odd base the base has an inverse,
so the hash of any span comes from one prefix sum: (P[end] - P[start]) * base**-start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CODE_POINTS = 0x110000
BASE = 0x9E3779B97F4A7C15  # odd
WORD_BASE = 0xD6E8FEB86659FD93  # odd, for hashes over words
#: Characters worked on at once: small enough for the processor's cache; a longer text is taken alone, but whole.
BLOCK = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def char_values() -> np.ndarray:
    """A 64-bit value for each code point."""
    return mix(np.arange(CODE_POINTS, dtype=np.uint64), 7)


@cache
def is_word_char() -> np.ndarray:
    """Letters and digits of any script; an underscore is neither."""
    return np.fromiter((chr(c).isalnum() for c in range(CODE_POINTS)), np.bool_, CODE_POINTS)


@cache
def is_space_char() -> np.ndarray:
    """Unicode white space; the byte-order mark is none."""
    return np.fromiter((chr(c).isspace() and not 0x1C <= c <= 0x1F for c in range(CODE_POINTS)), np.bool_, CODE_POINTS)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and base**-0..-(n-1), modulo 2**64; kept and enlarged as needed."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(BLOCK + 4096, 1 << (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(up), np.cumprod(down)
    return have[0][:n], have[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """The polynomial hash of values[start:end] for each span."""
    up, down = powers(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[:-1], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each followed by a line feed, and where each begins; one more for the end."""
    data = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=begins[1:])
    return data, begins


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(texts: list[str], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the number of words before each text; ``inside`` tells the characters of words."""
    data, begins = code_points(texts)
    starts, ends = spans(inside[data])
    return mix(span_hashes(char_values()[data], starts, ends)), np.searchsorted(starts, begins)


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of letters and digits, lower-cased."""
    return words([t.lower() for t in texts], is_word_char())


def space_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words between white space, exactly as written."""
    return words(texts, ~is_space_char())


def owners(bounds: np.ndarray) -> np.ndarray:
    """For items laid out one group after another, the group of each item; bounds: where each group begins."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each run of ``size`` words that lies within one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    of = owners(bounds)
    at = np.flatnonzero(of[:n] == of[size - 1 :])
    return mix(span_hashes(hashes, at, at + size, WORD_BASE), size), at


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK characters; every text is in one range, whole."""
    first = chars = 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > BLOCK:
            yield first, i
            first, chars = i, 0
        chars += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists from their items laid out one list after another."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), pa.int32()), pa.array(values, kind))
