"""Collocations of two to four words by top-order marginalisation.

Every word occurrence opens one window: the word and the next three of its piece, padded with empty
strings where the piece ends. Only these longest windows are counted, with the count of a window combined in
each task; a ROLLUP over (lang, first, second, third, fourth word) then gives the counts of all phrases
of one to four words and the number of words as sums over their prefixes. No phrase of two or three
words is ever exploded for itself.

Most windows of a large corpus occur once, and moving them all would be many times the input. So a
window is also padded from the first word on that would make a word, pair or triple which occurs less than
``LEAST`` times: no phrase across it can be a candidate. These are counted before, by 64-bit hashes, each
length only where both shorter ones are frequent; the frequent ones come to the tasks as bitmaps of fixed size
(2 ** ``FILTER_BITS`` places). What is in a bitmap by chance only makes windows longer; the counts stay exact.

Hashes pre-aggregate windows within a task only, and are checked against a second family; rows carry
the words themselves.

Defined results: null text is empty; null lang is ``und``; rows without words add nothing; repeated rows count
each; other columns are not looked at, ids neither. An empty table gives no rows. A language with fewer
candidates has fewer than ``TOP`` rows. Order is total: score, count, phrase (UTF-8 bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firnlake.llm.common import bitmap, in_large_tasks, stored, table, text_or_empty
from firnlake.llm.tokens import FIRST, SECOND, groups, in_filter, kinds, mix, slices, words

LONGEST = 4
LEAST = 30
TOP = 2000
COVER = 80  # per cent of a phrase's occurrences inside a longer candidate
FILTER_BITS = 26
SALTS = 64
UNKNOWN = "und"

# What ends a piece, and what stands between words.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
SPACES = b"\x20\x09"

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_KINDS = kinds(SPACES, BREAKS)


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty().alias("text"))


def _grouped(batch: pa.RecordBatch, families: tuple) -> Iterator[tuple]:
    """Words of runs of texts, whether each is followed by another of its piece, and the language of each."""
    langs = batch.column(0).dictionary_encode()
    names = langs.dictionary.to_pylist()
    codes, marks = langs.indices.to_numpy(), np.array([_lang_hash(x) for x in names], dtype=np.uint64)
    for first, data, bounds in groups(batch.column(1)):
        found = words(data, bounds, _KINDS, families)
        if len(found.begin):
            joined = np.zeros(len(found.begin), dtype=bool)
            joined[:-1] = (found.owner[1:] == found.owner[:-1]) & (found.piece[1:] == found.piece[:-1])
            lang = codes[first + found.owner]
            yield found, joined, lang, marks[lang], names


def _gram_hashes(h: np.ndarray, mark: np.ndarray, size: int) -> np.ndarray:
    """Of the ``size`` words from each place on; only meant where they are joined."""
    out = mix(h + mark)
    for i in range(1, size):
        out[: len(h) - i] = mix(out[: len(h) - i] * _STEP + h[i:])
    return out


def _both(hit: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Places whose word is joined to the next, both being hits."""
    out = hit & joined
    out[:-1] &= hit[1:]
    return out


def _frequent(found, joined: np.ndarray, mark: np.ndarray, known: list[np.ndarray]) -> list[np.ndarray]:
    """For each length with a bitmap, the places where a frequent phrase of the length begins."""
    out: list[np.ndarray] = []
    for size, bits in enumerate(known, 1):
        possible = _both(out[-1], joined) if out else np.ones(len(joined), dtype=bool)
        out.append(possible & in_filter(bits, _gram_hashes(found.hashes[0], mark, size)))
    return out


def frequent_phrases(texts: DataFrame, least: int, bits: int = FILTER_BITS) -> list[np.ndarray]:
    """Bitmaps of the words, pairs and triples that occur at least ``least`` times in their language."""
    known: list[np.ndarray] = []
    context = texts.sparkSession.sparkContext
    for size in range(1, LONGEST):
        shared = context.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], size=size, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for found, joined, _, mark, _ in _grouped(batch, (FIRST,)):
                    hashes = _gram_hashes(found.hashes[0], mark, size)
                    if size > 1:
                        hashes = hashes[_both(_frequent(found, joined, mark, shared.value)[-1], joined)]
                    values, n = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["phrase", "n"])

        counts = texts.mapInArrow(run, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n"))
        known = [*known, bitmap(counts.where(F.col("n") >= least), "phrase", bits)]
    return known


WINDOW = [f"w{i}" for i in range(LONGEST)]


def _combined(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first place and the count of each different window; ``two`` tells windows of equal ``one`` apart."""
    order = np.argsort(one, kind="stable")
    new = np.r_[True, one[order][1:] != one[order][:-1]]
    if (two[order][1:] != two[order][:-1])[~new[1:]].any():
        order = np.lexsort((two, one))
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    heads = np.flatnonzero(new)
    return order[heads], np.diff(np.r_[heads, len(order)])


def count_windows(texts: DataFrame, known: list[np.ndarray]) -> DataFrame:
    """(lang, w0 to w3, n): the padded windows; a task sends each of its windows once per run of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, joined, lang, mark, names in _grouped(batch, (FIRST, SECOND)):
                count = len(joined)
                frequent = _frequent(found, joined, mark, shared.value)
                frequent.append(_both(frequent[-1], joined))
                reach = np.sum(frequent, axis=0)
                one, two = mark.copy(), mark.copy()
                for i, places in enumerate(frequent):
                    here = np.flatnonzero(places)
                    one[here] = mix(one[here] * _STEP + found.hashes[0][here + i])
                    two[here] = mix(two[here] * _STEP + found.hashes[1][here + i])
                place, n = _combined(one, two)
                parts = []
                for i in range(LONGEST):
                    at = np.minimum(place + i, count - 1)
                    word = slices(found.data, found.begin[at], np.where(reach[place] > i, found.size[at], 0))
                    # nulls are skipped, but a row must not be null throughout
                    parts.append(pc.if_else(pa.array(reach[place] > i), word, pa.scalar(None, pa.string())) if i else word)
                joined_words = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
                langs = pa.array(names).take(pa.array(lang[place]))
                yield pa.RecordBatch.from_arrays([langs, joined_words, pa.array(n, pa.int64())], names=["lang", "words", "n"])

    # one text a window moves less than four; the columns are made after the sum
    counted = texts.mapInArrow(run, "lang string, words string, n long").groupBy("lang", "words").agg(F.sum("n").alias("n"))
    listed = F.split("words", " ")
    columns = [F.coalesce(F.get(listed, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(WINDOW)]
    return counted.select("lang", *columns, "n")


def phrase_counts(windows: DataFrame, least: int) -> DataFrame:
    """(lang, size, phrase, f) of the phrases of one to four words with at least ``least`` occurrences; size 0: all words."""
    rolled = windows.rollup("lang", *WINDOW).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    size = F.lit(-1)
    for i in range(LONGEST + 1):  # the grouping id has a bit for each column that is summed over
        size = F.when(F.col("level") == (1 << (LONGEST - i)) - 1, i).otherwise(size)
    rolled = rolled.withColumn("size", size).where("size >= 0")
    last = F.element_at(F.array(F.lit("-"), *WINDOW), F.col("size") + 1)  # padding is no phrase
    phrase = F.concat_ws(" ", *[F.when(F.col("size") > i, F.col(c)) for i, c in enumerate(WINDOW)])
    return rolled.where((last != "") & ((F.col("f") >= least) | (F.col("size") == 0))).select("lang", "size", phrase.alias("phrase"), "f")


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Each candidate with its lowest-scoring cut."""
    w = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k",
        F.concat_ws(" ", F.slice(w, F.lit(1), F.col("k"))).alias("first"),
        F.concat_ws(" ", F.slice(w, F.col("k") + 1, F.col("size") - F.col("k"))).alias("rest"),
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    both = both.withColumn("score", score)
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _covered(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer candidate around each phrase."""
    w = F.split("phrase", " ")
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> concat_ws(' ', slice(w, i, s)))))"
    )
    parts = candidates.where("size > 2").withColumn("w", w).select("lang", "a", F.explode(inner).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    """The first ``top`` collocations of every language: lang, rank, phrase, a, l, r, n, score.

    ``least`` must be 1 or more. Products are exact up to counts of 19 digits.
    """
    texts = _texts(docs)
    # most windows of a task are the same phrases as everywhere: larger tasks send fewer
    windows = stored(count_windows(in_large_tasks(texts), frequent_phrases(texts, least, bits)), "phrase-windows")
    counts = stored(phrase_counts(windows, least), "phrase-counts")
    candidates = counts.where("size >= 2").withColumnRenamed("f", "a")
    longer = _covered(candidates)
    kept = _scored(candidates, counts.where("size >= 1")).join(longer, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(cover) * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each salt first, so that no task sorts a whole language
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 strongest collocations of every language."""
    return collocations(table(spark, folder, "documents").select("lang", "text"))


OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT id, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
q AS (SELECT row_number() OVER () AS pid, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT pid, lang, w, unnest(range(1, len(w) + 1)) AS i FROM q WHERE len(w) > 0),
g AS (SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS phrase, count(*) AS f
  FROM o CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(s) WHERE i + s - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE s = 1 GROUP BY lang),
c AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE s >= 2 AND f >= 30),
k AS (SELECT c.lang, c.s, phrase, a, unnest(range(1, c.s)) AS k, w FROM c),
x AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r,
    CAST((2000000::HUGEINT * k.a) // (l.f::HUGEINT + r.f::HUGEINT) AS BIGINT) AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ')
    JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, unnest(list_concat(
    [array_to_string(w[j:j + 1], ' ') FOR j IN range(1, s)],
    CASE WHEN s = 4 THEN [array_to_string(w[j:j + 2], ' ') FOR j IN range(1, 3)] ELSE [] END)) AS phrase
  FROM c WHERE s > 2),
z AS (SELECT y.* FROM y WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = y.lang AND i.phrase = y.phrase AND 100 * i.a >= 80 * y.a)),
r AS (SELECT z.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(n.n AS BIGINT) AS n, r.score
FROM r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""
