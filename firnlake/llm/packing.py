"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to the smallest context tier (a power of two) that holds them; pieces of the
top tier's length are cut off longer ones first. Within a block of documents every window is opened
by the longest piece left, in the tier that fits it, and its gap is filled from shorter tiers: the
longest piece that fits, or, when all are too long, a part cut off the shortest. So every window of
a block but its last is full. The windows of a tier are then dealt to step groups of equal token
count, the costliest first and always to the group with the least attention cost so far.

A block is a run of documents of one input partition, closed at ``block_tokens`` tokens, so no
shuffle is needed, memory is bounded by one block (or one document, if that is longer) and a lost
task is repeated alone. Padding is at most one window a block.

Defined results: a null text is an empty text, which still has its end id. Repeated rows and
repeated or null ids are documents of their own. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnlake.llm.common import table, text_or_empty

TIERS = (256, 512, 1024, 2048)
END_ID = 1
BLOCK_TOKENS = 1 << 20
STEP_TOKENS = 8 * 2048  # tokens of one step group

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("step_group", T.LongType()),
    ]
)


# -- tokenising -------------------------------------------------------------------------------


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, as little-endian bytes.

    The merges run in ``tiktoken`` with the ranks of the same file. A text whose white space is
    single separators falls into parts at its spaces that are encoded on their own; their ids are
    kept in a table of bounded size; those not in it are encoded together. Other texts are encoded whole, and
    those that ``tiktoken`` gives up (a million blanks in a row) by the ``tokenizers`` library itself.
    """

    KEPT = 50_000

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        back = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {
            bytes(back[c] for c in piece): rank
            for piece, rank in spec["model"]["vocab"].items()
            if piece not in special
        }
        self.path, self.plain = path, None
        self.special = special
        self.coder = tiktoken.Encoding(
            "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self.opens = np.zeros(1 + max([*ranks.values(), *special.values()]), dtype=bool)
        self.opens[[rank for piece, rank in ranks.items() if piece.startswith(b" ")]] = True
        self.parts: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        try:
            ids = self.coder.encode(text, allowed_special="all") if self.special else self.coder.encode_ordinary(text)
        except ValueError:  # the pattern's stack has an end
            ids = self._plainly(text)
        return np.array(ids, dtype="<u4")

    def _plainly(self, text: str) -> list[int]:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return self.plain.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        # every white-space run must be one character for the parts to be independent
        if len(text.split()) != _separators(text) + 1 or any(s in text for s in self.special):
            return self._ids(text).tobytes()
        first, *rest = text.split(" ")
        out = [self.parts.get(part) for part in rest]
        missing = [i for i, ids in enumerate(out) if ids is None]
        if missing:
            ids = self._ids(" " + " ".join([rest[i] for i in missing]))
            starts = np.flatnonzero(self.opens[ids])  # only a part's first id begins with a space
            raw, bounds = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            for i, begin, end in zip(missing, bounds[:-1], bounds[1:], strict=True):
                out[i] = raw[begin:end]
                if len(self.parts) < self.KEPT and len(rest[i]) < 64:
                    self.parts[rest[i]] = out[i]
        return self._ids(first).tobytes() + b"".join(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process, so that later tasks find its parts."""
    return Encoder(path)


_ODD = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _separators(text: str) -> int:
    """White-space characters, or -2 if there are others than spaces and line ends."""
    if not text.isascii() and any(c in text for c in _ODD[8:]) or any(c in text for c in _ODD[:8]):
        return -2
    return text.count(" ") + text.count("\n")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(shifted)) for b in range(256)]


# -- packing one block ------------------------------------------------------------------------


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows of a block: lists of (document, start, length)."""
    top, tiers = max(tiers), tuple(sorted(tiers))
    windows: list[list[tuple[int, int, int]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), sorted
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= top:
            windows.append([(d, start, top)])
            start += top
        if n > start:
            pool.append((n - start, d, start))
    pool.sort()
    while pool:
        length, d, start = pool.pop()
        window, size = [(d, start, length)], next(t for t in tiers if t >= length)
        gap = size - length
        while gap and pool:
            at = bisect_right(pool, (gap, float("inf"), 0))
            if at:
                length, d, start = pool.pop(at - 1)
                window.append((d, start, length))
                gap -= length
            else:  # all pieces are longer than the gap: cut the shortest
                length, d, start = pool.pop(0)
                window.append((d, start, gap))
                insort(pool, (length - gap, d, start + gap))
                gap = 0
        windows.extend(_full_parts(window, size - gap, tiers) if gap else [window])
    return windows


def _full_parts(window: list[tuple[int, int, int]], filled: int, tiers: tuple[int, ...]) -> list[list[tuple[int, int, int]]]:
    """The last window of a block, cut into full windows of smaller tiers and one rest."""
    out: list[list[tuple[int, int, int]]] = []
    pieces = list(reversed(window))
    while pieces:
        size = next((t for t in reversed(tiers) if t <= filled), filled)
        room, part = size, []
        while room:
            d, start, length = pieces.pop()
            take = min(length, room)
            part.append((d, start, take))
            if length > take:
                pieces.append((d, start + take, length - take))
            room -= take
        out.append(part)
        filled -= size
    return out


def balance(windows: list[list[tuple[int, int, int]]], tiers: tuple[int, ...], step_tokens: int) -> list[tuple[int, int]]:
    """(tier, step group within the block) of each window; groups of a tier have like attention cost."""
    of_tier: dict[int, list[int]] = {}
    for i, window in enumerate(windows):
        filled = sum(n for _, _, n in window)
        of_tier.setdefault(next(t for t in sorted(tiers) if t >= filled), []).append(i)
    out = [(0, 0)] * len(windows)
    first = 0
    for tier in sorted(of_tier):
        members = of_tier[tier]
        room = max(1, step_tokens // tier)
        groups = -(-len(members) // room)
        cost = {i: sum(n * n for _, _, n in windows[i]) for i in members}
        heap = [(0, 0, g) for g in range(groups)]
        for i in sorted(members, key=lambda i: (-cost[i], i)):
            spent, count, g = heapq.heappop(heap)
            out[i] = (tier, first + g)
            if count + 1 < room:
                heapq.heappush(heap, (spent + cost[i], count + 1, g))
        first += groups
    return out


# -- Spark ------------------------------------------------------------------------------------


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = BLOCK_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pieces of all documents, placed in windows; ``docs`` has doc_id and text.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can open.
    """
    if not tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        end = np.array([END_ID], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        state = {"sequence": 0, "group": 0}
        block: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            windows = pack_block([len(ids) // 4 for _, ids in block], tiers)
            places = balance(windows, tiers, step_tokens)
            rows: list[tuple] = []
            for window, (tier, group) in zip(windows, places, strict=True):
                offset = 0
                for d, start, length in window:
                    doc_id, ids = block[d]
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    rows.append(
                        (doc_id, start, length, crc, len(ids) // 4, base + state["sequence"], offset, tier, base + state["group"] + group)
                    )
                    offset += length
                state["sequence"] += 1
            state["group"] += 1 + max((g for _, g in places), default=0)
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if f.name == "tier" else pa.int64()) for c, f in zip(columns, PIECES, strict=True)],
                names=PIECES.names,
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                block.append((doc_id, ids))
                size += len(ids) // 4
                if size >= block_tokens:
                    yield from flush()
                    block, size = [], 0
        if block:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into windows of at most 2048 tokens."""
    return pack(table(spark, folder, "documents"))
