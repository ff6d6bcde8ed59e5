"""Words of batches of texts by array operations: places and 64-bit hashes, no loop over words.

Texts are UTF-8; every separator is an ASCII character, so bytes can be looked at one by one. Hashes are
polynomials modulo 2 ** 64 over a random letter table, scrambled. Two families (``FIRST``, ``SECOND``) serve
callers that check one against the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U = np.uint64
GROUP_BYTES = 1 << 20  # texts are taken together up to so many bytes
BLOCK_BYTES = 1 << 18  # hashed at a time, so that the arrays stay small whatever the length of a text

LETTER, SPACE, BREAK = 0, 1, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only


def kinds(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """The kind of every byte value."""
    out = np.full(256, LETTER, dtype=np.uint8)
    out[list(spaces)] = SPACE
    out[list(breaks)] = BREAK
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Family:
    """One hash function of words; its tables reach over one block."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(1, 2**63, 256).astype(np.uint64)
        self.base = int(rng.integers(1, 2**62)) * 2 + 1
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def _powers(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the base and of its inverse."""
        out = []
        for base in (self.base, pow(self.base, -1, 2**64)):
            powers = np.full(size, _U(base), dtype=np.uint64)
            powers[0] = 1
            out.append(np.multiply.accumulate(powers))
        return out[0], out[1]

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words at some places of a block."""
        if len(data) <= BLOCK_BYTES:
            if self.tables is None or len(self.tables[0]) < BLOCK_BYTES:
                self.tables = self._powers(BLOCK_BYTES)
            powers, inverses = self.tables
        else:  # one word that is longer than a block
            powers, inverses = self._powers(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * powers[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[begin]) * inverses[begin] + (end - begin).astype(np.uint64))


FIRST, SECOND = Family(5), Family(6)


class Words(NamedTuple):
    data: np.ndarray  # the bytes, A-Z lower-cased if asked for
    begin: np.ndarray  # first byte of each word
    size: np.ndarray
    owner: np.ndarray  # number of the text
    piece: np.ndarray  # grows at every break; comparable within a text only
    hashes: tuple[np.ndarray, ...]  # by family


def _cuts(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> list[int]:
    """Places, none inside a word, that cut the data into blocks."""
    out, at, n = [0], 0, len(data)
    while n - at > BLOCK_BYTES:
        end = at + BLOCK_BYTES
        place = int(bounds[np.searchsorted(bounds, end, side="right") - 1])
        if place <= at:  # inside one text: after its last separator, or the next one
            inside = np.flatnonzero(table[data[at:end]] != LETTER)
            if len(inside):
                place = at + int(inside[-1]) + 1
            else:
                place = n
                for step in range(end, n, BLOCK_BYTES):
                    later = np.flatnonzero(table[data[step : step + BLOCK_BYTES]] != LETTER)
                    if len(later):
                        place = step + int(later[0])
                        break
                after = np.searchsorted(bounds, at, side="right")
                if after < len(bounds):
                    place = min(place, int(bounds[after]))
        out.append(place)
        at = place
    if at < n:
        out.append(n)
    return out


def words(
    data: np.ndarray, bounds: np.ndarray, table: np.ndarray, families: tuple[Family, ...] = (FIRST,), lower: bool = True
) -> Words:
    """Words of texts laid end to end; ``bounds`` has the first byte of every text, and the end."""
    low = _LOWER[data] if lower else data
    found: list[tuple] = []
    breaks = 0
    cuts = _cuts(data, bounds, table)
    for a, b in zip(cuts, cuts[1:], strict=False):
        block = low[a:b]
        kind = table[block]
        inside = kind == LETTER
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = bounds[np.searchsorted(bounds, a, side="right") : np.searchsorted(bounds, b)] - a
        first[at] = inside[at]
        last[at - 1] = inside[at - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        ends = np.flatnonzero(kind == BREAK)
        found.append((begin + a, end - begin, np.searchsorted(ends, begin) + breaks, *[f.hashes(block, begin, end) for f in families]))
        breaks += len(ends)
    if not found:
        empty = np.empty(0, dtype=np.int64)
        return Words(low, empty, empty, empty, empty, tuple(np.empty(0, dtype=np.uint64) for _ in families))
    begin, size, piece, *hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(begin, bounds)))
    return Words(low, begin, size, owner, piece, tuple(hashes))


def groups(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of bounded size (or one long text): first text, bytes, bounds."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.binary()), np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, side="right")) - 1)
        bounds = offsets[first : last + 1]
        yield first, data[bounds[0] : bounds[-1]], bounds - bounds[0]
        first = last


def slices(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings at some places; size 0 is the empty string."""
    ends = np.cumsum(size)
    places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[places].tobytes()))


# -- fixed-size filters -----------------------------------------------------------------------


def filter_words(bits: int) -> int:
    return 1 << (bits - 6)


def in_filter(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the hash may be in the set that the bitmap was made of; never False for a member."""
    slot = hashes & _U(len(table) * 64 - 1)
    return (table[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) == 1
