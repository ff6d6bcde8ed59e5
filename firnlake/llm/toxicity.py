"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Text is compressed as a stream of word codes: eight hashed bytes for the word and for each of its
beginnings of ``STEMS`` letters. A code either matches a dictionary entry whole or costs its eight
bytes, so short windows differ by the words they share with a dictionary and not by chance matches
of letters. The ordinary dictionary holds the codes most common in ordinary training text. The toxic
dictionary holds those too, so that ordinary words cost the same in both, and before them the codes
that occur in far more toxic than ordinary texts. A window of ``WINDOW`` words is compressed with
each; its gain is the difference in length. A text's largest gain, its windows with a gain and their
share go through a logistic calibration, fitted on training texts that the dictionaries have not seen
and weighted to the class sizes of all labelled rows.

Training takes at most ``ROWS`` texts per class with ``SAMPLE_CHARS`` characters in all (texts in the
order of a hash of their id), which bounds the work on the driver; every text is then scored whole,
by tasks that hold one text at a time.

Defined results: null texts are empty; a text without words has no gain and gets the calibrated score
for that. Rows are scored by their text alone, so repeated rows and null ids are no matter. Labels
that are null, contradictory copies or without a document are ignored or used as they are. Without
both classes in the training rows every score is the share of toxic labels (0 without labels).
Empty tables give no rows. Other columns pass through in ``score_texts``.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnlake.llm.common import fresh, table, text_or_empty

WINDOW = 8
STEMS = (5, 7)
ROWS = 4000
SAMPLE_CHARS = 24_000_000
ORDINARY_CODES = 3000
TOXIC_CODES = 600
THRESHOLD = 0.3
STRIPPED = ".,;:!?\"'()[]{}#*$%&|<>-_"
KEPT_WORDS = 50_000


class Codes(dict):
    """Codes of a word; the table is bounded, later words are coded anew."""

    def __missing__(self, word: str) -> bytes:
        code = b"".join(code_list(word))
        if len(self) < KEPT_WORDS and len(word) < 64:
            self[word] = code
        return code


def code_list(word: str) -> list[bytes]:
    bare = word.strip(STRIPPED) or word
    forms = [bare, *[bare[:n] + "~" for n in STEMS if len(bare) > n]]
    return [hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=8).digest() for f in forms]


def windows(text: str, codes: Codes) -> list[bytes]:
    words = [codes[w] for w in text.lower().split()]
    return [b"".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]


@dataclass
class Model:
    """The two dictionaries and the calibration; small enough to travel with every task."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])
    constant: float | None = None

    def scorer(self):
        """A function from a text to its score."""
        if self.constant is not None:
            return lambda _: self.constant
        codes, ordinary, toxic, w = Codes(), _compressor(self.ordinary), _compressor(self.toxic), self.weights

        def score(text: str) -> float:
            x = gains(windows(text, codes), ordinary, toxic)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))

        return score


def _compressor(content: bytes):
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17, chain_log=16,
        hash_log=16, search_log=5, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress


def gains(parts: list[bytes], ordinary, toxic) -> tuple[float, float, float, float]:
    """1, largest gain, logarithm of the windows with a gain, and their share."""
    found = [len(ordinary(p)) - len(toxic(p)) for p in parts]
    some = sum(g >= 3 for g in found)
    return 1.0, min(max(found, default=0), 40) / 10, math.log1p(some), some / max(1, len(found))


# -- training ---------------------------------------------------------------------------------


def fit(samples: list[tuple[str, int]], totals: dict[int, int]) -> Model:
    """From (text, label) samples and the numbers of labelled rows of each class."""
    seen: dict[str, int] = {}
    for text, label in samples:
        seen.setdefault(text, label)
    texts = sorted(seen.items(), key=lambda x: hashlib.blake2b(x[0].encode("utf-8", "surrogatepass"), digest_size=8).digest())
    everything = sum(totals.values())
    if len({label for _, label in texts}) < 2:
        return Model(constant=totals.get(1, 0) / everything if everything else 0.0)
    by_class = [[t for t, label in texts if label == k] for k in (0, 1)]
    # two thirds for the dictionaries, the rest for the calibration (all for both if too few)
    few = min(map(len, by_class)) < 6
    learn = [c if few else c[: len(c) * 2 // 3] for c in by_class]
    judge = [c if few else c[len(c) * 2 // 3 :] for c in by_class]
    counts: list[Counter] = [Counter(), Counter()]
    common: Counter = Counter()
    for k in (0, 1):
        for text in learn[k]:
            words = text.lower().split()
            if k == 0:
                common.update(words)
            counts[k].update({c for w in set(words) for c in code_list(w)})
    marked = []
    for code, n in counts[1].items():
        odds = math.log(((n + 0.1) / (len(learn[1]) + 0.2)) / ((counts[0][code] + 0.1) / (len(learn[0]) + 0.2)))
        if n >= 3 and odds > 2 and n * odds > 9:
            marked.append((n * odds, code))
    codes = Codes()
    ordinary = b"".join(codes[w] for w, _ in reversed(common.most_common(ORDINARY_CODES)))
    toxic = b"".join(code for _, code in sorted(marked)[-TOXIC_CODES:]) + ordinary
    a, b = _compressor(ordinary or b"\0" * 8), _compressor(toxic or b"\0" * 8)
    x = np.array([gains(windows(t, codes), a, b) for k in (0, 1) for t in judge[k]])
    y = np.array([k for k in (0, 1) for _ in judge[k]], dtype=float)
    weight = np.array([totals.get(k, 1) / max(1, len(judge[k])) for k in (0, 1) for _ in judge[k]])
    return Model(ordinary or b"\0" * 8, toxic or b"\0" * 8, _logistic(x, y, weight * len(y) / weight.sum()).tolist())


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a little shrinkage, by Newton's method."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 0.05, 0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ w
        w = w + np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, slope)
    return w


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Dictionaries and calibration from the labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    totals = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(4))
    samples: list[tuple[str, int]] = []
    for label in (0, 1):
        chosen = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(rows)
        found = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("text").cast("string").alias("text"))
        sized = found.where("text is not null").select("doc_id", F.length("text").alias("n"), "text")
        room = sample_chars // 2
        # at most ``rows`` texts; those beyond the bound on characters do not reach the driver
        for r in sized.orderBy(order, "doc_id").where(F.col("n") <= max(1, room // 20)).limit(rows).toLocalIterator():
            room -= r["n"]
            if room < 0:
                break
            samples.append((r.text, label))
    return fit(samples, totals)


def score_texts(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in a new column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for texts in batches:
            yield texts.map(score)

    return docs.withColumn(name, scored(text_or_empty()))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not judged toxic."""
    name = fresh(docs, "toxicity")
    return score_texts(docs, train(docs, labels), name).where(F.col(name) < threshold).select(*docs.columns)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels"))
    scored = score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
