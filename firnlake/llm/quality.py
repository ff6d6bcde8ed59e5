"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame functions only.

Each text is measured once (words, characters in words, symbols, repeated lines, words in repeated
8-word windows). Base limits reject very short and very repetitive texts. The other rules have no
fixed cutoff: for each language and source KLL sketches of each figure are built (combined in each
task before the shuffle, so a hot source sends one sketch per task), and a text fails if a figure
lies more than ``reach`` spreads (q75 - q25) outside the middle half of its group. Shares are 0 in most
texts, which leaves no spread; they have a second sketch of the values above 0, and the upper limit
is at least its quantile ``level``: a share fails if it is unusual among all texts of the group, and among
those that have it at all. ``floor`` is a numerical guard against groups of equal values. Groups of fewer than
``MIN_ROWS`` texts use the merged sketch of their language, and languages of fewer use
that of all texts. The thresholds are joined back by language and source.

Defined results: null texts have no words and fail the base limits; null language or source is a
group of its own. Repeated rows are measured and returned once each. Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnlake.llm.common import WHITE, stored, table, text_or_empty

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_ROWS = 200
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Figure:
    """A figure, how many spreads are usual, the least spread, and the quantile of the values above 0 that still is.

    Without ``level`` low values fail too.
    """

    name: str
    reach: float
    floor: float
    level: float | None = None


FIGURES = (Figure("mean_word", 4.0, 0.05), Figure("symbol_share", 3.0, 0.003, level=0.1), Figure("dup_line_share", 3.0, 0.003, level=0.75))


def bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_words(text: Column) -> Column:
    spaced = F.translate(text, WHITE[1:], " " * (len(WHITE) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found at least twice in the text."""

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, window)))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return bound_to(placed, lambda s: _union_length(_repeats(s), window))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return bound_to(
        hashes, lambda h: F.when(F.size(h) <= window, F.lit(0)).otherwise(bound_to(windows(h), count))
    ).cast("long")


def _repeats(s: Column) -> Column:
    """Ascending places of the windows that equal a neighbour in hash order."""
    pairs = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def _union_length(starts: Column, window: int) -> Column:
    zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))

    def step(done: Column, start: Column) -> Column:
        return F.struct(start.alias("last"), (done["total"] + F.least(F.lit(window), start - done["last"])).alias("total"))

    return F.aggregate(starts, zero, step, lambda done: done["total"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base figures of every text."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    figures = docs.select("doc_id", "lang", "source", text_or_empty().alias("text")).select(
        "doc_id",
        "lang",
        "source",
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound_to(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        bound_to(split_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat"))).alias("words"),
    )
    return figures.select(
        "doc_id",
        "lang",
        "source",
        F.col("words")["n"].alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines")["dup"].alias("n_dup_lines"),
        F.col("words")["repeat"].alias("n_repeat_words"),
        F.col("lines")["n"].alias("n_lines"),
    )


def _ratios(measured: DataFrame) -> DataFrame:
    n = F.col("n_words")
    return measured.withColumns(
        {
            "mean_word": F.when(n > 0, F.col("word_chars") / n),
            "symbol_share": F.when(n > 0, F.col("n_symbols") / n),
            "dup_line_share": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")),
        }
    )


def thresholds(rated: DataFrame, figures: tuple[Figure, ...] = FIGURES, min_rows: int = MIN_ROWS) -> DataFrame:
    """lo_ and hi_ of each figure for each (lang, source)."""
    usable = rated.where("n_words > 0")
    # every figure, and its values above 0 under a name of their own
    above = {f"{f.name}_above": F.when(F.col(f.name) > 0, F.col(f.name)) for f in figures if f.level is not None}
    sketched = [f.name for f in figures] + list(above)
    sketches = [F.kll_sketch_agg_double(F.col(c)).alias(c) for c in sketched]
    counts = [F.count(F.col(c)).alias(f"n_{c}") for c in above]
    groups = usable.withColumns(above).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *counts, *sketches)
    groups = stored(groups, "quality-sketches")

    def merged(keys: list[Column], mark: str) -> DataFrame:
        sums = [F.sum(c).alias(f"{mark}_{c}") for c in ["n", *[f"n_{c}" for c in above]]]
        return groups.groupBy(*keys).agg(*sums, *[F.kll_merge_agg_double(c).alias(f"{mark}_{c}") for c in sketched])

    by_lang = merged([F.col("lang").alias("l_lang")], "l")
    overall = merged([F.lit(0).alias("a_all")], "a")  # one row
    joined = groups.join(by_lang, groups["lang"].eqNullSafe(by_lang["l_lang"])).withColumn("all", F.lit(0))
    joined = joined.join(F.broadcast(overall), F.col("all") == F.col("a_all"))

    def of_group(column: str) -> Column:
        """A column of the group, of its language or of all, whichever has enough texts."""
        return (
            F.when(F.col("n") >= min_rows, F.col(column)).when(F.col("l_n") >= min_rows, F.col(f"l_{column}")).otherwise(F.col(f"a_{column}"))
        )

    columns = [F.col("lang").alias("t_lang"), F.col("source").alias("t_source")]
    for f in figures:
        q25, q75 = (F.kll_sketch_get_quantile_double(of_group(f.name), F.lit(q)) for q in (0.25, 0.75))
        spread = F.greatest(q75 - q25, F.lit(f.floor)) * f.reach
        low, high = q25 - spread, q75 + spread
        if f.level is not None:
            usual = F.kll_sketch_get_quantile_double(of_group(f"{f.name}_above"), F.lit(f.level))
            low, high = F.lit(float("-inf")), F.greatest(high, F.when(of_group(f"n_{f.name}_above") > 0, usual))
        columns += [high.alias(f"hi_{f.name}"), low.alias(f"lo_{f.name}")]
    return joined.select(*columns)


def judge(docs: DataFrame, figures: tuple[Figure, ...] = FIGURES, min_rows: int = MIN_ROWS) -> DataFrame:
    """Figures and verdicts of every document."""
    rated = _ratios(stored(measure(docs), "quality-figures"))
    limits = stored(thresholds(rated, figures, min_rows), "quality-limits")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    outside = F.lit(False)
    for f in figures:
        outside = outside | F.coalesce(~F.col(f.name).between(F.col(f"lo_{f.name}"), F.col(f"hi_{f.name}")), F.lit(False))
    same = rated["lang"].eqNullSafe(limits["t_lang"]) & rated["source"].eqNullSafe(limits["t_source"])
    return rated.join(limits, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~outside).alias("kept"),
        *[f"hi_{f.name}" for f in figures],
    )


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document measured and judged."""
    return judge(table(spark, folder, "documents"))
