"""Removal of repeated byte strings by external induced suffix sorting.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts anywhere else too, in the
same or another document. Sorting all suffixes of a corpus at once would move many bytes per byte
of text, so the work is cut down to what can repeat, without losing a string:

1. Every string of ``LENGTH`` bytes has an anchor, the ``GRAM``-byte piece in it with the least
   hash (the first of equals). Equal strings have equal anchors at equal places. A document's
   string starts fall into segments with a common anchor, about one per 120 bytes.
2. Segments whose anchor occurs once cannot repeat. If all segments of an anchor are equal (128 bits
   of hash), they repeat whole. Both are settled by sums per anchor, combined in each task.
3. Of the other segments one copy of each text is kept. They are shared out by anchor into shards, and
   those that share no region around the anchor with another one (``may_repeat``) are left out.
   A shard's suffixes are sorted by external induced sorting (``induced_sort``), and starts whose common
   prefix with a neighbour reaches ``LENGTH`` repeat. The sort spills its queues to the executor's own disk
   beyond a bound on their tuples; shards of ``SHARD_BYTES`` stay below it, larger ones would not.
4. An anchor with more than ``HOT`` different segments (a passage a little shorter than ``LENGTH``
   in a large part of all documents) is not put into one shard: its segments are split by
   start, each start being a 128-bit hash of its string, and the hashes are counted in Spark.

The starts are brought back to all copies and documents on (anchor, segment) keys that AQE can split.

Defined results: text is taken as UTF-8; a null text is empty. Texts shorter than ``LENGTH`` never
lose a byte. Rows that are equal in id and text are documents of their own, so all their strings
repeat. Null ids are handled like others. Empty tables give no rows. ``remove_repeats`` keeps all
columns and rows; removing bytes may split a character, whose other bytes then go too.

``remove_repeats`` can also cut passages of ``words`` words (runs of bytes other than U+0020 and U+0009
to U+000D) that start at several places, however few bytes they have and whatever white space is
between them. Each word becomes a code of ``CODE`` bytes, its hash, and the strings of ``words`` codes
are found as above. A passage goes from its first word to its last.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnlake.llm.common import WHITE, fresh, stored, table, text_or_empty
from firnlake.llm.induced_sort import sorted_suffixes
from firnlake.llm.tokens import groups, kinds
from firnlake.llm.tokens import words as words_of

LENGTH = 400
GRAM = 160
HOT = 20_000
SHARD_BYTES = 4 << 20
PIECE_BYTES = 1 << 18
REGIONS = 8  # regions around an anchor, one of which a repeated string must share
CODE = 6  # bytes of a word's code

_U = np.uint64


# -- anchors ----------------------------------------------------------------------------------


class Hasher:
    """Polynomial hashes of all substrings of a block of at most ``size`` bytes, modulo 2 ** 64."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(1, 2**63, 256).astype(np.uint64)
        base = _U(int(rng.integers(1, 2**62)) * 2 + 1)
        inverse = _U(pow(int(base), -1, 2**64))
        self.powers = self._powers(base, size)
        self.inverses = self._powers(inverse, size + 1)

    @staticmethod
    def _powers(base: np.uint64, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (prefix[end] - prefix[begin]) * self.inverses[begin]
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _hashers(length: int) -> tuple[Hasher, Hasher]:
    """Two families for blocks of texts; made for a task and given up with it."""
    return Hasher(2 * PIECE_BYTES + 4 * length, 11), Hasher(2 * PIECE_BYTES + 4 * length, 23)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbouring values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - width + 1)
    return np.minimum(behind[starts], ahead[starts + width - 1])


def segments(data: np.ndarray, owners: np.ndarray, length: int, gram: int, hashers: tuple[Hasher, Hasher]):
    """Of a block of texts laid end to end: begin, number of starts, anchor hash and text hash of segments.

    ``owners`` has the text number of every byte; no string reaches over two texts.
    """
    n = len(data)
    empty = np.empty(0, dtype=np.int64)
    if n < length:
        return empty, empty, empty, empty
    one, two = hashers
    p1 = one.prefix(data)
    grams = np.arange(n - gram + 1)
    hashes = one.between(p1, grams, grams + gram)
    # 42 bits of the hash, then the place: the least is the first of the least
    keyed = (hashes & ~_U((1 << 22) - 1)) | grams.astype(np.uint64)
    least = _window_minima(keyed, length - gram + 1)
    starts = np.flatnonzero(owners[: n - length + 1] == owners[length - 1 :])
    if not len(starts):
        return empty, empty, empty, empty
    anchors = (least[starts] & _U((1 << 22) - 1)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)])
    begin = starts[heads]
    counts = np.diff(np.r_[heads, len(starts)])
    anchor = anchors[heads]
    p2 = two.prefix(data)
    text = two.between(p2, begin, begin + counts - 1 + length) + (anchor - begin).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    return begin, counts, hashes[anchor].view(np.int64), (text + counts.astype(np.uint64)).view(np.int64)


def _blocks(texts: Iterator[tuple[int, bytes]], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Blocks of bounded size: bytes, owner of each byte, and (row, place in block, place in text) of its parts."""
    parts: list[bytes] = []
    placed: list[tuple[int, int, int]] = []
    size = 0

    def block():
        sizes = [len(p) for p in parts]
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.repeat(np.arange(len(parts)), sizes), placed

    for row, text in texts:
        # long texts come in parts that overlap by one byte less than a string
        for at in range(0, max(1, len(text) - length + 1), PIECE_BYTES):
            part = text[at : at + PIECE_BYTES + length - 1]
            parts.append(part)
            placed.append((row, size, at))
            size += len(part)
            if size >= PIECE_BYTES:
                yield block()
                parts, placed, size = [], [], 0
    if parts:
        yield block()


def _rows(docs: DataFrame) -> DataFrame:
    """id and tie name a text; rows that are equal in both share their result."""
    text = text_or_empty()
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("tie"), F.encode(text, "UTF-8").alias("bytes")
    )


SEGMENTS = "id long, tie long, begin int, starts int, anchor long, text long"


def find_segments(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, coded: bool = False) -> DataFrame:
    """Segments of the bytes, or of the codes of their words: coded here, not by a Python worker of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _hashers(length)
        for batch in batches:
            ids, ties = (np.array(batch.column(i)) for i in (0, 1))
            column = batch.column(2)
            found = _codes(column) if coded else (column[i].as_py() for i in range(len(column)))
            texts = ((i, x) for i, x in enumerate(found) if len(x) >= length)
            for data, owners, placed in _blocks(texts, length):
                begin, starts, anchor, text = segments(data, owners, length, gram, hashers)
                if not len(begin):
                    continue
                part = owners[begin]
                row, at, shift = (np.array(x) for x in zip(*placed, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[row[part]]), pa.array(ties[row[part]]), pa.array((begin - at[part] + shift[part]).astype(np.int32)),
                        pa.array(starts.astype(np.int32)), pa.array(anchor), pa.array(text),
                    ],
                    names=["id", "tie", "begin", "starts", "anchor", "text"],
                )

    # of a code's word there is a byte at least
    return rows.where(F.octet_length("bytes") >= (length // CODE if coded else length)).mapInArrow(run, SEGMENTS)


# -- repeated starts of different segments ----------------------------------------------------


def may_repeat(parts: list[tuple[int, bytes]], length: int, gram: int, hasher: Hasher) -> np.ndarray:
    """Which segments, given as (anchor, bytes), can share a string of ``length`` bytes with another one.

    Of a string that two segments share, the anchor lies at one of length - gram + 1 places. Cut into
    ``REGIONS`` ranges of ``step`` places, the string holds the region of length - step bytes that begins
    at the range's end; so both segments have that region around their anchors. Regions are compared by hash.
    """
    sizes = np.array([len(x) for _, x in parts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    anchors = np.array([a for a, _ in parts], dtype=np.int64)
    step = -(-(length - gram) // REGIONS)
    hit = np.zeros(len(parts), dtype=bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    limit = len(hasher.powers) - 1
    first = 0
    while first < len(parts):  # as many segments as the hasher's tables reach
        last = max(first + 1, int(np.searchsorted(begins + sizes, begins[first] + limit, side="right")))
        mine = slice(first, last)
        at, size = begins[mine] - begins[first], sizes[mine]
        if size[0] > limit:  # cannot be looked at in one go: kept
            hit[first] = True
            first = last
            continue
        data = np.frombuffer(b"".join(x for _, x in parts[mine]), dtype=np.uint8)
        prefix = hasher.prefix(data)
        grams = np.arange(max(0, len(data) - gram + 1))
        owner = np.repeat(np.arange(len(at)), size)[: len(grams)]
        same = hasher.between(prefix, grams, grams + gram).view(np.int64) == anchors[mine][owner]
        # the anchor is the first such piece; one that runs over the end of a segment comes after it
        places = np.flatnonzero(same)
        owners, where = np.unique(owner[places], return_index=True)
        lost = np.setdiff1d(np.arange(len(at)), owners)
        hit[first + lost] = True
        place = places[where]
        for j in range(REGIONS):
            begin = place - step * j
            end = begin + length - step
            whole = np.flatnonzero((begin >= at[owners]) & (end <= at[owners] + size[owners]))
            region = hasher.between(prefix, begin[whole], end[whole]) + _U(j) * _U(0x9E3779B97F4A7C15)
            found.append((first + owners[whole], region))
        first = last
    if found:
        numbers, regions = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(regions, kind="stable")
        equal = regions[order][1:] == regions[order][:-1]
        hit[numbers[order[1:][equal]]] = True
        hit[numbers[order[:-1][equal]]] = True
    return hit


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each text, the starts of strings of ``length`` bytes that begin at two places of the texts."""
    sizes = np.array([len(t) for t in texts])
    begins = np.r_[0, np.cumsum(sizes + 1)]
    joined = np.zeros(begins[-1], dtype=np.uint16)
    for text, at in zip(texts, begins, strict=False):
        joined[at : at + len(text)] = np.frombuffer(text, dtype=np.uint8).astype(np.uint16) + 1
    hit = np.zeros(len(joined), dtype=bool)
    last = -1
    for suffixes, common in sorted_suffixes(joined, length):
        whole = common >= length
        neighbours = np.r_[last, suffixes[:-1]]
        hit[suffixes[whole]] = True
        hit[neighbours[whole]] = True
        last = int(suffixes[-1])
    # a common prefix that runs over the end of a text is none
    place = np.flatnonzero(hit)
    owner = np.searchsorted(begins, place, side="right") - 1
    inside = place - begins[owner] + length <= sizes[owner]
    place, owner = place[inside], owner[inside]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [place[a:b] - begins[i] for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _as_runs(starts: np.ndarray) -> list[dict]:
    """Runs of consecutive starts, both ends included."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    first, last = np.r_[starts[0], starts[cut + 1]], np.r_[starts[cut], starts[-1]]
    return [{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)]


RUNS = "array<struct<first:int,last:int>>"
RUN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _cut_out(rows: DataFrame, wanted: DataFrame, length: int, coded: bool = False) -> DataFrame:
    """anchor, text and bytes of the wanted segments; ``wanted`` has at most one row per (anchor, text)."""
    per_text = wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("begin", "starts", "anchor", "text")).alias("wanted"))
    once = rows.join(per_text, ["id", "tie"]).select("bytes", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _codes(batch.column(0)) if coded else (x.as_py() for x in batch.column(0))
            for data, listed in zip(texts, batch.column(1), strict=True):
                rows_ = listed.as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["anchor"] for w in rows_], pa.int64()),
                        pa.array([w["text"] for w in rows_], pa.int64()),
                        pa.array([data[w["begin"] : w["begin"] + w["starts"] - 1 + length] for w in rows_], pa.binary()),
                    ],
                    names=["anchor", "text", "part"],
                )

    return once.mapInArrow(run, "anchor long, text long, part binary")


def _sort_shards(parts: DataFrame, length: int, gram: int, shard_bytes: int) -> DataFrame:
    """Repeated starts of segments; all segments of an anchor are in one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hashers(length)[0]
        shard: dict[tuple[int, int], bytes] = {}
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            some = may_repeat([(a, x) for (a, _), x in shard.items()], length, gram, hasher)
            left = {k: x for (k, x), y in zip(shard.items(), some, strict=True) if y}
            found = [_as_runs(x) for x in repeated_starts(list(left.values()), length)] if left else []
            rows = [(a, t, r) for (a, t), r in zip(left, found, strict=True) if r]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], RUN_TYPE)],
                names=["anchor", "text", "runs"],
            )

        for batch in batches:
            for anchor, text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if size >= shard_bytes and anchor != last:
                    yield flush()
                    shard, size = {}, 0
                # rows equal in id and text give a segment twice; it is one text
                if (anchor, text) not in shard:
                    shard[anchor, text] = part.as_py()
                    size += len(shard[anchor, text])
                last = anchor
        if shard:
            yield flush()

    count = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(count, "anchor").sortWithinPartitions("anchor", "text")
    return dealt.mapInArrow(run, f"anchor long, text long, runs {RUNS}")


def _count_strings(parts: DataFrame, length: int) -> DataFrame:
    """Repeated starts of the segments of hot anchors, by 128-bit hashes of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = part.as_py()
                n = len(data) - length + 1
                marks = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * n, pa.int64()), pa.array([text] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(marks, pa.binary())],
                    names=["anchor", "text", "start", "mark"],
                )

    strings = parts.dropDuplicates(["anchor", "text"]).mapInArrow(run, "anchor long, text long, start int, mark binary")
    strings = stored(strings, "suffix-strings")
    several = strings.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    hits = strings.join(several, "mark").groupBy("anchor", "text").agg(F.sort_array(F.collect_set("start")).alias("found"))
    return hits.select("anchor", "text", F.transform("found", lambda x: F.struct(x.alias("first"), x.alias("last"))).alias("runs"))


def covered(
    rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES, coded: bool = False
) -> DataFrame:
    """(id, tie, spans) of the texts that lose bytes; spans are (first byte, first byte after), of the codes if ``coded``."""
    found = stored(find_segments(rows, length, gram, coded), "suffix-segments")
    anchors = (
        found.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("lo"), F.max("text").alias("hi"))
        .where("n > 1")
        .select("anchor", (F.col("lo") == F.col("hi")).alias("alike"))
    )
    # written first: a join of two plain shuffles is one that AQE can split at a hot anchor
    anchors = stored(anchors, "suffix-anchors")
    # written before it is summed up: else AQE cannot split the join at a hot anchor
    hits = stored(found.join(anchors, "anchor"), "suffix-met")
    # rows equal in id and text are one here, with their number
    hits = hits.groupBy("id", "tie", "begin", "starts", "anchor", "text", "alike").agg(F.count(F.lit(1)).alias("rows"))
    hits = stored(hits, "suffix-hits")
    # one copy of each different segment of an anchor
    kinds = (
        hits.where("NOT alike")
        .groupBy("anchor", "text")
        .agg(F.sum("rows").alias("copies"), F.min(F.struct("id", "tie", "begin", "starts")).alias("one"))
        .select("anchor", "text", "copies", "one.*")
    )
    kinds = stored(kinds, "suffix-kinds")
    big = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor"), "suffix-hot")
    some_big = not big.isEmpty()
    parts = _cut_out(rows, kinds, length, coded)
    if some_big:
        parts = stored(parts, "suffix-parts")
        runs = _sort_shards(parts.join(big, "anchor", "left_anti"), length, gram, shard_bytes).unionByName(_count_strings(parts.join(big, "anchor"), length))
    else:
        runs = _sort_shards(parts, length, gram, shard_bytes)
    runs = stored(runs, "suffix-runs")
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("starts") - 1).alias("last")))
    settled = kinds.select("anchor", "text", "copies", "starts").join(runs, ["anchor", "text"], "left")
    settled = settled.select(
        F.col("anchor").alias("s_anchor"), F.col("text").alias("s_text"), F.when(F.col("copies") > 1, whole).otherwise(F.col("runs")).alias("runs")
    ).where("runs is not null")
    settled = stored(settled, "suffix-settled")
    different = hits.where("NOT alike").join(settled, (F.col("anchor") == F.col("s_anchor")) & (F.col("text") == F.col("s_text")))
    spans = hits.where("alike").select("id", "tie", "begin", "starts", whole.alias("runs")).unionByName(
        different.select("id", "tie", "begin", "starts", "runs")
    )
    spans = spans.select(
        "id", "tie", F.transform("runs", lambda r: F.struct((F.col("begin") + r["first"]).alias("first"), (F.col("begin") + r["last"] + length).alias("end"))).alias("spans")
    )
    return spans.groupBy("id", "tie").agg(F.flatten(F.collect_list("spans")).alias("spans"))


# -- results ----------------------------------------------------------------------------------


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((first, end))
    return out


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for first, end in spans:
        kept.append(data[at:first])
        at = end
    kept.append(data[at:])
    return b"".join(kept)


def _listed(spans: pa.Array) -> Iterator[list[tuple[int, int]]]:
    for x in spans.to_pylist():
        yield merge_spans([(s["first"], s["end"]) for s in x or ()])


def repeat_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of what is kept, of every row."""
    rows = _rows(docs)
    spans = covered(rows, length, gram, hot, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, found in zip(batch.column(0).to_pylist(), batch.column(1), _listed(batch.column(2)), strict=True):
                data = text.as_py()
                kept = _without(data, found)
                out.append((None if id_ == -(1 << 63) else id_, len(data), len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest()))
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    joined = rows.join(spans, ["id", "tie"], "left").select("id", "bytes", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


_WORD_KINDS = kinds(WHITE.encode())


def _codes(texts: pa.Array) -> list[bytes]:
    """The codes of the words of each text."""
    out: list[bytes] = []
    for _, data, bounds in groups(texts):
        found = words_of(data, bounds, _WORD_KINDS, lower=False)
        codes = found.hashes[0].view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes()
        ends = np.searchsorted(found.owner, np.arange(len(bounds))) * CODE
        out += [codes[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def _word_spans(data: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Bytes of the text that spans of its codes stand for; only whole codes count."""
    whole = [(-(-first // CODE), end // CODE) for first, end in spans]
    whole = merge_spans([(a, b) for a, b in whole if b - a >= words])
    if not whole:
        return []
    places = [x.span() for x in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    return [(places[a][0], places[b - 1][1]) for a, b in whole]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES, words: int | None = None
) -> DataFrame:
    """``docs`` with repeated strings cut out of text, and n_chars (if there) set to what is left.

    With ``words``, repeated passages of so many words go as well.
    """
    rows = _rows(docs)
    spans = covered(rows, length, gram, hot, shard_bytes).select("id", "tie", "spans")
    none = F.array().cast("array<struct<first:int,end:int>>")
    if words:
        passages = covered(rows, words * CODE, words * CODE * 2 // 5, hot, shard_bytes, coded=True)
        both = spans.withColumn("passages", none).unionByName(passages.select("id", "tie", none.alias("spans"), F.col("spans").alias("passages")))
        spans = both.groupBy("id", "tie").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("passages")).alias("passages"))
    else:
        spans = spans.withColumn("passages", none)
    id_, tie, found, more, left = (fresh(docs, f"cut_{c}") for c in ("id", "tie", "spans", "passages", "text"))
    spans = spans.select(F.col("id").alias(id_), F.col("tie").alias(tie), F.col("spans").alias(found), F.col("passages").alias(more))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series, passages: pd.Series) -> pd.Series:
        out = []
        for text, spans_, passages_ in zip(texts, found, passages, strict=True):
            data = text.encode()
            listed = [(s["first"], s["end"]) for s in spans_]
            if len(passages_):
                listed += _word_spans(data, [(s["first"], s["end"]) for s in passages_], words)
            out.append(_without(data, merge_spans(listed)).decode(errors="ignore"))
        return pd.Series(out)

    key = (F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))) == F.col(id_)) & (F.xxhash64(text_or_empty()) == F.col(tie))
    joined = docs.join(spans, key, "left")
    joined = joined.withColumn(left, cut(text_or_empty(), F.coalesce(found, none), F.coalesce(more, none)))
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.col(left))
    result = joined.select(*[text.alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns])
    for c in docs.columns:
        if c.lower() == "n_chars":
            result = result.withColumn(c, F.length(F.col("text")).cast(docs.schema[c].dataType))
    return result


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What repeated 400-byte strings take from every document."""
    return repeat_report(table(spark, folder, "documents").select("doc_id", "text"))
