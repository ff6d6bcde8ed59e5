"""External induced sorting of suffixes, with their common-prefix values.

The sorted suffixes that begin left of a smaller-to-larger turn ("LMS") induce the order of all
others: scanning in order, the suffix one letter earlier joins the queue of its first letter. A
queue holds (suffix, common prefix with the one queued before) tuples in arrival order, which is
their sorted order, so the queues of all letters together are a priority queue by (first letter,
order of the rest). Chunks of tuples beyond ``memory`` go to files and are read back one by one. The
common prefix of two suffixes that enter a queue one after the other is one more than the least
value on the way between the suffixes that induced them. The LMS suffixes are sorted by sorting
and naming the pieces between them and recursing on the names, down to a string that is
sorted in memory by doubling.

Values are capped at ``depth``: suffixes that agree on ``depth`` letters may come in any order.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
PAIRS = 1 << 15  # suffix pairs compared at a time


class Queues:
    """One queue of (suffix, common prefix) chunks per letter, spilled to files beyond ``memory`` tuples."""

    def __init__(self, folder: str, name: str, memory: int):
        self.folder, self.name, self.memory, self.held = folder, name, memory, 0
        self.chunks: dict[int, list] = {}
        self.files = 0

    def add(self, letter: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.chunks.setdefault(letter, []).append((suffixes, common))
        self.held += len(suffixes)
        if self.held > self.memory:
            for parts in self.chunks.values():
                self._spill(parts)
            self.held = 0

    def _spill(self, parts: list) -> None:
        """The chunks in memory of one queue go to one file, in order."""
        first = next((i for i, p in enumerate(parts) if not isinstance(p, str)), len(parts))
        if first == len(parts):
            return
        path = f"{self.folder}/{self.name}-{self.files}"
        self.files += 1
        with open(path, "wb") as file:
            for suffixes, common in parts[first:]:
                np.save(file, suffixes)
                np.save(file, common)
        parts[first:] = [path]

    def take(self, letter: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples in arrival order, in chunks; what is added meanwhile comes too."""
        while self.chunks.get(letter):
            waiting: list = []
            for part in self.chunks.pop(letter):
                if not isinstance(part, str):
                    self.held -= len(part[0])
                    waiting.append(part)
                    continue
                yield from _joined(self._read(part))
            yield from _joined(waiting)

    def _read(self, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        with open(path, "rb") as file:
            size = os.fstat(file.fileno()).st_size
            while file.tell() < size:
                yield np.load(file), np.load(file)
        os.unlink(path)


def _joined(chunks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same tuples in chunks of at least ``CHUNK``, but for the last."""
    held, size = [], 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk[0])
        if size >= CHUNK:
            yield np.concatenate([c[0] for c in held]), np.concatenate([c[1] for c in held])
            held, size = [], 0
    if held:
        yield (held[0] if len(held) == 1 else (np.concatenate([c[0] for c in held]), np.concatenate([c[1] for c in held])))


def _place_type(n: int) -> type:
    """Of places in a text of ``n`` letters, and of the place after it."""
    return np.int32 if n < np.iinfo(np.int32).max else np.int64


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last letter is not."""
    n = len(text)
    small = np.zeros(n, dtype=bool)
    if n == 1:
        return small
    rises = text[1:] > text[:-1]
    turn = np.arange(n - 1, dtype=_place_type(n))
    turn[text[1:] == text[:-1]] = n - 1
    turn = np.minimum.accumulate(turn[::-1])[::-1]  # the next place where letters differ
    small[:-1] = rises[np.minimum(turn, n - 2)] & (turn != n - 1)
    return small


def _runs(text: np.ndarray) -> np.ndarray:
    """Length of the run of equal letters that begins at each place."""
    n = len(text)
    ends = np.arange(n, dtype=_place_type(n))
    ends[:-1][text[1:] == text[:-1]] = n
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    ends -= np.arange(-1, n - 1, dtype=ends.dtype)
    return ends


class _Minima:
    """Least values between places of a list."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum over [begin, end) where begin < end."""
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        out = np.empty(len(begin), dtype=self.rows[0].dtype)
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[begin[at]], row[end[at] - (1 << int(k))])
        return out


class _Scan:
    """One pass that queues the suffix before each scanned one, if it has the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, depth: int):
        self.text, self.wanted, self.queues, self.depth = text, wanted, queues, depth
        # least common prefix scanned since the last tuple of each letter's queue
        self.least: dict[int, int] = {}

    def letter(self) -> None:
        """A new first letter begins: nothing scanned before shares a prefix with what follows."""
        self.least = dict.fromkeys(self.least, 0)

    def feed(self, suffixes: np.ndarray, common: np.ndarray) -> None:
        before = suffixes - 1
        at = np.flatnonzero((suffixes > 0) & self.wanted[before])
        overall = int(common.min()) if len(common) else self.depth
        touched = set()
        if len(at):
            before = before[at]
            letters = self.text[before]
            order = np.argsort(letters, kind="stable")
            at, before, letters = at[order], before[order], letters[order]
            heads = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]])
            values = np.zeros(len(at), dtype=common.dtype)
            minima = _Minima(common)
            inner = np.ones(len(at), dtype=bool)
            inner[heads] = False
            inner = np.flatnonzero(inner)
            if len(inner):
                values[inner] = minima.between(at[inner - 1] + 1, at[inner] + 1)
            firsts = minima.between(np.zeros(len(heads), dtype=np.int64), at[heads] + 1)
            for head, tail, least in zip(heads, [*heads[1:], len(at)], firsts, strict=True):
                letter = int(letters[head])
                # the first tuple of a queue has nothing before it
                values[head] = min(int(least), self.least.get(letter, 0))
                part = np.minimum(values[head:tail].astype(np.int64) + 1, self.depth).astype(common.dtype)
                self.queues.add(letter, before[head:tail], part)
                rest = common[at[tail - 1] + 1 :]
                self.least[letter] = int(rest.min()) if len(rest) else self.depth
                touched.add(letter)
        for letter, least in self.least.items():
            if letter not in touched and least > overall:
                self.least[letter] = overall


def _induce(
    text: np.ndarray, small: np.ndarray, runs: np.ndarray, lms: np.ndarray, lms_common: np.ndarray, depth: int, folder: str, memory: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from last to first, in chunks, each with its common prefix with the one after it."""
    letters = np.unique(text)
    of = text[lms]
    order = np.argsort(of, kind="stable")
    lms, lms_common, of = lms[order], lms_common[order], of[order]
    begin, end = np.searchsorted(of, letters), np.searchsorted(of, letters, side="right")
    kind = lms_common.dtype

    # ascending: suffixes larger than the next one; each queue is kept in order for the way back
    large = Queues(folder, "l", memory)
    kept = Queues(folder, "k", memory)
    scan = _Scan(text, ~small, large, depth)
    n = len(text)
    large.add(int(text[n - 1]), np.array([n - 1], dtype=lms.dtype), np.zeros(1, dtype=kind))  # induced by the end, smaller than all
    for letter, b, e in zip(letters, begin, end, strict=True):
        scan.letter()
        last, fresh = None, True
        for suffixes, common in large.take(int(letter)):
            if fresh:
                common = common.copy()
                common[0], fresh = 0, False
            kept.add(int(letter), suffixes, common)
            scan.feed(suffixes, common)
            last = suffixes[-1]
        if e > b:
            common = lms_common[b:e].copy()
            common[0] = 0 if last is None else min(int(runs[last]), int(runs[lms[b]]), depth)
            scan.feed(lms[b:e], common)

    # descending: suffixes smaller than the next one, then the kept ones of the letter in reverse
    less = Queues(folder, "s", memory)
    scan = _Scan(text, small, less, depth)
    for letter in letters[::-1]:
        scan.letter()
        last, fresh = None, True
        for suffixes, common in less.take(int(letter)):
            if fresh:
                common = common.copy()
                common[0], fresh = 0, False
            scan.feed(suffixes, common)
            yield suffixes, common
            last = suffixes[-1]
        follower: int | None = None  # common prefix of the suffix just scanned with the next, smaller one
        for suffixes, common in reversed(list(kept.take(int(letter)))):
            back = suffixes[::-1]
            shifted = np.empty_like(common)
            shifted[1:] = common[1:][::-1]
            if follower is None:
                shifted[0] = 0 if last is None else min(int(runs[last]), int(runs[back[0]]), depth)
            else:
                shifted[0] = follower
            follower = int(common[0])
            scan.feed(back, shifted)
            yield back, shifted


def _sort_by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string in memory; ties that agree on ``depth`` letters stay."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth and rank.max(initial=0) < n - 1:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - width] = rank[width:]
        pair = rank * (n + 1) + second + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.argsort(rank, kind="stable")


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of suffix pairs, at most ``depth``, compared letter by letter in blocks.

    ``PAIRS`` pairs are looked at together: a block of all pairs would take many times the memory of the text.
    """
    n, block = len(text), 8
    wide = np.int32 if np.can_cast(text.dtype, np.int32) else np.int64
    padded = np.r_[text.astype(wide), np.arange(-1, -1 - depth - block, -1, dtype=wide)]
    out = np.zeros(len(a), dtype=np.uint16)
    steps = np.arange(block)
    for first in range(0, len(a), PAIRS):
        some, done = slice(first, first + PAIRS), 0
        one, two, found = a[some].astype(np.int64), b[some].astype(np.int64), out[some]
        live = np.arange(len(one))
        while len(live) and done < depth:
            left, right = one[live] + done, two[live] + done
            same = padded[np.minimum(left[:, None] + steps, n + depth)] == padded[np.minimum(right[:, None] + steps, n + depth)]
            equal = np.where(same.all(axis=1), block, same.argmin(axis=1))
            found[live] = np.minimum(done + equal, depth)
            live, done = live[equal == block], done + block
    return out


def sorted_suffixes(
    text: np.ndarray, depth: int, memory: int = 1 << 22, base: int = 1 << 23, folder: str | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``text`` from last to first, in chunks, each with its common prefix with the one after it.

    ``memory``: tuples held by the queues before they are written to files. ``base``: length up to
    which a string of names is sorted in memory.
    """
    if len(text) == 0:
        return
    own = folder is None
    place = tempfile.mkdtemp(prefix="suffixes-") if own else folder
    try:
        small, runs = _types(text), _runs(text)
        lms = np.flatnonzero(small & np.r_[False, ~small[:-1]]).astype(_place_type(len(text)))
        if len(lms) > 1:
            lms = lms[_lms_order(text, small, runs, lms, depth, memory, base, place)]
        common = np.zeros(len(lms), dtype=np.uint16)
        if len(lms) > 1:
            common[1:] = _common(text, lms[:-1], lms[1:], depth)
        yield from _induce(text, small, runs, lms, common, depth, place, memory)
    finally:
        if own:
            shutil.rmtree(place, ignore_errors=True)


def _lms_order(text, small, runs, lms, depth, memory, base, place) -> np.ndarray:
    """Order of the LMS suffixes: sort and name the pieces between them, then sort the names."""
    inner = tempfile.mkdtemp(dir=place)
    is_lms = np.zeros(len(text), dtype=bool)
    is_lms[lms] = True
    chunks = [s[is_lms[s]] for s, _ in _induce(text, small, runs, lms, np.zeros(len(lms), dtype=np.uint16), depth, inner, memory)]
    by_piece = np.concatenate(chunks)[::-1]
    ends = np.full(len(text), len(text) - 1, dtype=lms.dtype)
    ends[lms[:-1]] = lms[1:]
    sizes = ends[by_piece] - by_piece + 1
    del ends, is_lms, chunks
    longest = int(sizes.max())
    alike = np.zeros(len(by_piece), dtype=bool)
    same_size = np.flatnonzero(sizes[1:] == sizes[:-1])
    cap = min(longest, depth) if depth else longest
    equal = _common(text, by_piece[same_size], by_piece[same_size + 1], cap)
    alike[same_size + 1] = equal >= np.minimum(sizes[same_size], cap)
    names = np.empty(len(text), dtype=lms.dtype)
    names[by_piece] = np.cumsum(~alike)
    reduced = names[lms]
    if len(np.unique(reduced)) == len(reduced):
        return np.argsort(reduced)
    if len(reduced) <= base:
        return _sort_by_doubling(reduced, depth)
    return np.concatenate([s for s, _ in sorted_suffixes(reduced, depth, memory, base, inner)])[::-1]
