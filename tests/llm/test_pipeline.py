"""The corpus pipeline against its stages done one after the other in plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from firnlake.llm import packing, toxicity
from firnlake.llm.common import BATCH, BATCH_ROWS, table

from .test_duplicates_warc import plain_classes
from .test_packing_mixing_urls import plain_mix


def without_repeated(texts, length=400, passage=corpus_pipeline.PASSAGE):
    """Without the bytes of strings of ``length`` bytes and of passages of ``passage`` words that start at several places."""
    data = [t.encode() for t in texts]
    places = [[x.span() for x in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    words = [[d[a:b] for a, b in p] for d, p in zip(data, places, strict=True)]
    seen, said = Counter(), Counter()
    for d, w in zip(data, words, strict=True):
        seen.update(hashlib.blake2b(d[p : p + length], digest_size=12).digest() for p in range(len(d) - length + 1))
        said.update(tuple(w[i : i + passage]) for i in range(len(w) - passage + 1))
    out = []
    for d, w, at in zip(data, words, places, strict=True):
        keep = np.ones(len(d), dtype=bool)
        for p in range(len(d) - length + 1):
            if seen[hashlib.blake2b(d[p : p + length], digest_size=12).digest()] > 1:
                keep[p : p + length] = False
        again = np.zeros(len(w) + 1, dtype=int)
        for i in range(len(w) - passage + 1):
            if said[tuple(w[i : i + passage])] > 1:
                again[i : i + passage] = 1
        edges = np.flatnonzero(np.diff(np.r_[0, again]))
        for first, end in zip(edges[::2], edges[1::2], strict=True):
            keep[at[first][0] : at[end - 1][1]] = False
        out.append(bytes(np.frombuffer(d, np.uint8)[keep]).decode(errors="ignore"))
    return out


def test_pipeline_against_plain_python(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "mixing", "packing"]
    docs = table(spark, sf, "documents")
    score = toxicity.train(docs, table(spark, sf, "labels")).scorer()
    sources = corpus_pipeline.mixing.source_domain()
    rows = [r.asDict() for r in docs.withColumn("domain", sources).orderBy("doc_id").collect()]
    rows = [r for r in rows if score(r["text"]) < toxicity.THRESHOLD]
    classes = plain_classes([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r, c in zip(rows, classes, strict=True) if r["doc_id"] == c]
    for r, text in zip(rows, without_repeated([r["text"] for r in rows]), strict=True):
        r["text"], r["tokens"] = text, len(text.split())
    taken = plain_mix(rows, corpus_pipeline.WEIGHTS, corpus_pipeline.SHARE, 1, corpus_pipeline.SEED)
    taken = {i for i, _ in taken}
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: encode(r["text"]) + np.array([1], "<u4").tobytes() for r in rows if r["doc_id"] in taken}
    pieces = entry.queries()["pipeline"](spark, sf).toPandas()
    assert set(pieces.doc_id) == set(want)
    for doc_id, mine in pieces.groupby("doc_id"):
        ids, at = want[doc_id], 0
        for p in mine.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) // 4
            assert p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert 4 * at == len(ids)


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf):
    odd = spark.createDataFrame(
        [(1, None, None, None, None, "x"), (None, "", "en", "s1", 0, "x"), (2, "some words here " * 60, "en", "s1", 960, None),
         (2, "some words here " * 60, "en", "s1", 960, None), (3, "other words there", None, "s2", 17, "y")],
        "doc_id long, text string, lang string, source string, n_chars long, spans string",
    )
    for rows in (odd, odd.limit(0)):
        done = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, done, sf)
            assert done.columns == odd.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, done, sf)
        assert pieces.agg(F.count(F.lit(1))).first()[0] >= (rows is odd)


def test_repeated_passages_of_over_50_words_are_cut(spark, sf):
    rng = random.Random(8)

    def words(n, size):
        return [f"{rng.randrange(10**size):0{size}d}" for _ in range(n)]

    # 50 words stay, however long; 51 and more go, however short, and whatever white space is between them
    planted = {n: words(n, 2 + n % 4) for n in (50, 51, 52, 55, 58, 61, 63, 65)}
    assert all(len(" ".join(p)) < 400 for p in planted.values())
    rows, want = [], {}
    for n, passage in planted.items():
        for k in range(2):
            before, after = words(70, 8), words(40, 8)
            rows.append((100 * n + k, "\n".join([" ".join(before), (" ", "  ")[k].join(passage), " ".join(after)])))
            want[100 * n + k] = before + (passage if n <= 50 else []) + after
    long = words(20, 30)  # few words, over 400 bytes: still cut by bytes
    for k in range(2):
        before = words(70, 8)
        rows.append((k, " ".join([*before, *long, "."])))
        want[k] = before + ["."]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text.split() for r in corpus_pipeline.cut_repeats(spark, docs, sf).collect()}
    assert {i: t for i, t in got.items() if i > 1} == {i: t for i, t in want.items() if i > 1}
    assert all(not set(long[1:-1]) & set(got[k]) for k in range(2))


def test_stages_hand_rows_to_python_in_small_batches(spark):
    """And what they give does not depend on the size of a batch."""
    before = spark.conf.get(BATCH)
    words = [f"w{i}" for i in range(130)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 30, 3)] + [" ".join(f"own{i}_{j}" for j in range(90)) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sizes = spark.range(0, 3 * BATCH_ROWS, 1, 1).mapInArrow(lambda batches: (b.slice(0, 0).from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    try:
        spark.conf.set(BATCH, "10000")
        found = corpus_pipeline.cut_repeats(spark, docs, "")
        assert max(r["n"] for r in sizes.collect()) <= BATCH_ROWS
        spark.conf.set(BATCH, "3")
        again = corpus_pipeline.cut_repeats(spark, docs, "")
        assert spark.conf.get(BATCH) == "3"
        for out in (found, again):
            assert [r["text"] for r in out.orderBy("doc_id").collect()] == without_repeated(texts)
    finally:
        spark.conf.set(BATCH, before)
