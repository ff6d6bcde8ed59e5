"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from firnlake.llm import collocations, tokens


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        f = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(w)
            for s in range(1, 5):
                for i in range(len(w) - s + 1):
                    f[tuple(w[i : i + s])] += 1
    out = set()
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        found = []
        for p, a in cands.items():
            best = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()
            )
            if not inside:
                k = best[1]
                found.append((-best[0], -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def mined(spark, rows, least, **kwargs):
    docs = spark.createDataFrame(rows, "lang string, text string")
    return {tuple(r) for r in collocations.collocations(docs, least, **kwargs).collect()}


def texts(seed, count):
    rng = random.Random(seed)
    vocabulary = ["a", "A", "b", "ß", "Ä", "new x", "c-d", "x" * 5000, "日本"]
    gaps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", " ; "]
    rows = []
    for _ in range(count):
        text = "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return rows


@pytest.mark.parametrize("least", [2, 5])
def test_against_plain_counts(spark, least):
    rows = texts(3, 60) + [("en", None), (None, ""), ("fr", " \t\n.,")] + texts(4, 3) * 2
    assert mined(spark, rows, least) == plain(rows, least)


def test_the_bitmap_decides_no_count(spark):
    rows = texts(5, 40)
    assert mined(spark, rows, 3, bits=6) == plain(rows, 3)


def test_hot_phrase_ties_and_top(spark):
    rows = [("en", "same words again and again. " * 50)] * 20 + [("en", f"p{i} q{i} " * 4) for i in range(30)]
    assert mined(spark, rows, 4, top=7) == plain(rows, 4, 7)


def test_empty_table_extra_columns_and_long_texts(spark):
    assert mined(spark, [], 2) == set()
    rows = [("en", "one two three four five six. " * 60_000), ("en", "z" * 3_000_000 + " one two")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "lang string, text string, n long, phrase long, w0 long")
    assert {tuple(r) for r in collocations.collocations(docs).collect()} == plain(rows, 30)


def test_words_of_blocks():
    table = tokens.kinds(b" ", b".")
    texts_ = ["", "ab c", " ", "d" * 50, "é x.y", "z " * 40, ""]
    joined = pa.array(texts_)
    old = tokens.BLOCK_BYTES, tokens.GROUP_BYTES
    try:
        for block, group in ((7, 1000), (3, 10), (1 << 20, 4 << 20)):
            tokens.BLOCK_BYTES, tokens.GROUP_BYTES = block, group
            got = []
            for first, data, bounds in tokens.groups(joined):
                found = tokens.words(data, bounds, table)
                got += [(int(first + o), bytes(found.data[b : b + s]).decode()) for o, b, s in zip(found.owner, found.begin, found.size, strict=True)]
            assert got == [(i, w) for i, t in enumerate(texts_) for w in re.findall("[^ .]+", t)]
    finally:
        tokens.BLOCK_BYTES, tokens.GROUP_BYTES = old


def test_windows_of_equal_hash_are_told_apart():
    place, n = collocations._combined(np.array([5, 5, 5, 1], dtype=np.uint64), np.array([1, 2, 1, 9], dtype=np.uint64))
    assert sorted(zip(place.tolist(), n.tolist(), strict=True)) == [(0, 2), (1, 1), (3, 1)]
