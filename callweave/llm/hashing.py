"""Hashes of words and byte windows over whole Arrow columns, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(20240229)
_LETTER = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
#: An odd number has an inverse modulo 2^64, so a hash from prefix sums can be moved to a common place.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^(n-1) and their inverses, modulo 2^64; kept per process."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BACK)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Each value well scattered over 64 bits."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S[i]: polynomial hash of data[:i]; (S[e] - S[s]) * inverse power(s) depends on data[s:e] alone.

    Modulo 2^64, so texts made for it can collide: for orders and candidates. What decides uses `Fingerprints`.
    """
    forth, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    terms = _LETTER.take(data)
    terms *= forth[:-1]
    np.cumsum(terms, out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


def grams_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` bytes from each place on."""
    n = len(sums) - size
    return (sums[size:] - sums[:n]) * powers(len(sums))[1][:n]


#: 2^31 - 1: products of two residues fit 64 bits, and no structure of the bytes survives as it does modulo 2^64.
_PRIME, _BITS = np.uint64((1 << 31) - 1), np.uint64(31)
_BASES = tuple(int(x) for x in _SEED.integers(1 << 20, (1 << 31) - 2, 2))
_RESIDUES = [_SEED.integers(1, (1 << 31) - 1, 256, dtype=np.uint64) for _ in _BASES]
_residue_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64)] * 2 for _ in _BASES]


def _folded(x: np.ndarray) -> np.ndarray:
    """Congruent modulo 2^31 - 1 and below 2^33."""
    return (x & _PRIME) + (x >> _BITS)


def _residues(n: int, k: int) -> list[np.ndarray]:
    """Powers of base k and of its inverse modulo the prime, by doubling."""
    while len(_residue_powers[k][0]) < n:
        size = len(_residue_powers[k][0])
        for j, base in enumerate((_BASES[k], pow(_BASES[k], -1, int(_PRIME)))):
            jump = np.uint64(pow(base, size, int(_PRIME)))
            known = _residue_powers[k][j]
            _residue_powers[k][j] = np.concatenate([known, known * jump % _PRIME])
    return _residue_powers[k]


class Fingerprints:
    """62-bit hashes of stretches of bytes: two polynomials with random bases modulo a prime."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        for k, letters in enumerate(_RESIDUES):
            out = np.zeros(len(data) + 1, np.uint64)
            terms = letters.take(data)
            terms *= _residues(len(data) + 1, k)[0][: len(data)]
            high = terms >> _BITS
            terms &= _PRIME
            terms += high
            np.cumsum(terms, out=out[1:])
            self.sums.append(out)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = np.zeros(len(starts), np.uint64)
        for k, sums in enumerate(self.sums):
            part = _folded(_folded(sums[ends] - sums[starts]))  # below 2^31 + 8
            part *= _residues(len(sums), k)[1][starts]
            part = _folded(_folded(part))
            part -= _PRIME * (part >= _PRIME)
            found = found << _BITS | part
        return found


_places: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2
_WORD_LETTERS = [_SEED.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in range(2)]


def words_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each word (words are disjoint and in order): a random number a place and letter."""
    sizes = ends - starts
    if not len(sizes):
        return [np.zeros(0, np.uint64)] * 2
    longest = int(sizes.max())
    if len(_places[0]) < longest:
        for k in range(2):
            _places[k] = mixed(np.arange(2 * longest, dtype=np.uint64), 101 + k)
    heads = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
    letters = data[place + np.repeat(starts, sizes)]
    size = sizes.astype(np.uint64)
    return [mixed(np.add.reduceat(_places[k][place] * _WORD_LETTERS[k][letters], heads) + size, 17 + k) for k in range(2)]


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows that hold about `limit` bytes together."""
    _, offsets = column_bytes(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right"))
        end = min(max(end - 1, start + 1), len(texts))
        yield start, end
        start = end
