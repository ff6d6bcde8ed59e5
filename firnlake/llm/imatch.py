"""I-Match fingerprints over randomised lexicon subsets, in DataFrame functions only.

A term is a run of letters or digits, lower-cased, known by its 64-bit hash. Document frequencies are
counted per term over all documents, combined in each task. The lexicon holds the terms whose share of
documents lies within ``BAND``. A document has some hundred different terms, so at most that number divided by the
band's lower end can be in it, however many documents there are: the lexicon is collected and
becomes a set in the plan.

Of a text, the distinct terms in the lexicon are kept and sorted. The fingerprint hashes them once
per lexicon subset: the lexicon is dealt at random into subsets, twice (``LEVELS``): coarse ones for
short texts and finer ones, of which a part is used, for long texts.
A text without a kept term is fingerprinted over all its terms. Each subset gives four hex digits, or
``----`` if the text has no term in it. The likeness of two fingerprints is the share of equal
subsets among those filled in either, at the finer level if enough of it is filled, else at the
coarse one; equal fingerprints have 1.

The next document of each is found by range partitions of (doc_id, text hash): a window inside a
partition and the first rows of the partitions, never one global window.

Defined results: a null text is empty; texts without terms have a fingerprint of dashes. Documents
with equal id and text count as one document and get equal rows; equal ids with different texts
are ordered by the text's hash; null ids come first. A single document is its own next. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnlake.llm.common import stored, table, text_or_empty
from firnlake.llm.quality import bound_to

BAND = (0.005, 0.05)
LEVELS = ((16, 16), (128, 32))  # subsets that a lexicon deal makes, and how many of them are used
FILLED = 4  # subsets of the finer deal that must be filled for it to count
EMPTY = "----"


def term_hashes(text: Column) -> Column:
    """Distinct hashes of the terms of a text."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[int]:
    """The terms within the band; at most the mean number of terms of a document divided by ``band[0]``."""
    terms = docs.select(F.explode(term_hashes(text_or_empty())).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    inside = counts.where((F.col("n") >= F.lit(band[0] * total)) & (F.col("n") <= F.lit(band[1] * total)))
    return inside.select("term").toArrow().column("term").to_pylist()


def kept_terms(text: Column, known: list[int]) -> Column:
    """Sorted distinct terms in the lexicon, or all terms if none is."""

    def choose(terms: Column) -> Column:
        return bound_to(F.filter(terms, lambda t: t.isin(known)), lambda k: F.when(F.size(k) > 0, k).otherwise(terms))

    return F.sort_array(bound_to(term_hashes(text), choose))


def fingerprint(text: Column, known: list[int]) -> Column:
    """Hashes of the kept terms of each lexicon subset, in one text."""

    def code(members: Column) -> Column:
        digits = F.lpad(F.lower(F.hex(F.xxhash64(members).bitwiseAND(F.lit(0xFFFF)))), 4, "0")
        return F.when(F.size(members) == 0, F.lit(EMPTY)).otherwise(digits)

    def level(kept: Column, parts: int, used: int) -> Column:
        dealt = F.transform(
            kept, lambda t: F.struct(F.pmod(F.xxhash64(t, F.lit(parts)), F.lit(parts)).cast("int").alias("s"), t.alias("t"))
        )
        return bound_to(
            dealt if used == parts else F.filter(dealt, lambda x: x["s"] < used),
            lambda u: F.array_join(
                F.transform(
                    F.sequence(F.lit(0), F.lit(used - 1)),
                    lambda j: bound_to(F.transform(F.filter(u, lambda x: x["s"] == j), lambda x: x["t"]), code),
                ),
                "",
            ),
        )

    return bound_to(kept_terms(text, known), lambda k: F.concat(*[level(k, *deal) for deal in LEVELS]))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subsets among those filled in either fingerprint."""

    def level(first: int, used: int) -> Column:
        def step(done: Column, j: Column) -> Column:
            x, y = F.substr(a, j * 4 + 1, F.lit(4)), F.substr(b, j * 4 + 1, F.lit(4))
            filled = ~((x == EMPTY) & (y == EMPTY))
            return F.struct(
                (done["n"] + filled.cast("int")).alias("n"), (done["same"] + (filled & (x == y)).cast("int")).alias("same")
            )

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("same"))
        return F.aggregate(F.sequence(F.lit(first), F.lit(first + used - 1)), zero, step)

    def share(counts: Column) -> Column:
        return F.when(counts["n"] > 0, counts["same"] / counts["n"]).otherwise(F.lit(0.0))

    (_, coarse), (_, fine) = LEVELS
    found = bound_to(level(coarse, fine), lambda f: F.when(f["n"] >= FILLED, share(f)).otherwise(share(level(0, coarse))))
    return F.when(a == b, F.lit(1.0)).otherwise(found)


def next_documents(keys: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``keys`` (distinct rows of ``order``) with next_<column>; the last row's next is the first."""
    placed = stored(
        keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "next-keys"
    )
    row = F.struct(*order)
    firsts = placed.groupBy("part").agg(F.min(row).alias("first_row"))
    by_part = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per partition
    follow = firsts.select(
        "part",
        F.coalesce(
            F.lead("first_row").over(by_part),
            F.first("first_row").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("follow"),
    )
    inside = F.lead(row).over(Window.partitionBy("part").orderBy(*order))
    found = placed.withColumn("inside", inside).join(follow, "part").withColumn("__next", F.coalesce("inside", "follow"))
    return found.select(*keys.columns, *[F.col("__next")[c].alias(f"next_{c}") for c in order])


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, text and fingerprint of every document."""
    known = lexicon(docs, band)
    return docs.select("doc_id", text_or_empty().alias("text")).withColumn("fingerprint", fingerprint(F.col("text"), known))


def compare_edited(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of the documents and of their edited texts, and how alike they are."""
    spark = docs.sparkSession
    known = lexicon(docs, band)
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    sizes = rows.select("id", "tie", F.length("text").alias("n")).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    follow = stored(next_documents(sizes, ["id", "tie"], parts), "imatch-next")
    # both roles of a document: it is edited, and it gives its beginning to the one before
    roles = follow.select("id", "tie", "n", "next_id", "next_tie").join(
        follow.select(
            F.col("next_id").alias("id"), F.col("next_tie").alias("tie"), F.col("id").alias("to_id"), F.col("tie").alias("to_tie"),
            F.floor(F.col("n") / 2).cast("int").alias("to_half"),
        ),
        ["id", "tie"],
    )
    roles = stored(roles.select("id", "tie", "n", "to_id", "to_tie", "to_half"), "imatch-roles")
    # one exchange of the texts serves both roles
    whole = rows.withColumn("fingerprint", fingerprint(F.col("text"), known)).join(roles, ["id", "tie"])
    given = whole.select(
        F.col("to_id").alias("id"), F.col("to_tie").alias("tie"),
        F.struct(F.expr("left(text, to_half)").alias("head"), F.col("fingerprint").alias("next_fingerprint")).alias("given"),
    ).groupBy("id", "tie").agg(F.first("given").alias("given"))
    edited = F.expr("concat(left(text, n - cast(floor(n / 2) as int)), given.head)")
    out = whole.select("id", "tie", "n", "text", "fingerprint").join(given, ["id", "tie"])
    out = out.select(
        F.when(F.col("id") != lowest, F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "fingerprint",
        F.col("given.next_fingerprint").alias("next_fingerprint"),
        bound_to(
            edited, lambda e: F.struct(F.sha2(e, 256).alias("sha256"), fingerprint(e, known).alias("fingerprint"))
        ).alias("edited"),
    )
    edited_fingerprint = F.col("edited")["fingerprint"]
    return out.select(
        "doc_id",
        "n_chars",
        F.col("edited")["sha256"].alias("edited_sha256"),
        "fingerprint",
        edited_fingerprint.alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), edited_fingerprint).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op7_imatch(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint against that of its edited text and of the next document."""
    return compare_edited(table(spark, folder, "documents"))
