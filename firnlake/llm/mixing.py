"""Mixing sources to target weights by hierarchical budgeting.

Every document is a leaf member of a tree domain -> language -> source. A total token budget is
split top-down. At a node the budget goes to its children in proportion to their weights; a child
cannot take more than its capacity (tokens below it times ``max_epochs``), and what it cannot take
is dealt again among its siblings. As a node never gets more than its own capacity, a shortage
reaches an ancestor's other children only when all siblings are full.

In closed form: with siblings in ascending order of capacity / weight, a child is full if that
ratio is at most (budget - capacities before it) / (weights from it on); the others share what is
left at one level. So the tree needs a window over siblings per level and nothing on the driver.

A leaf takes whole epochs of its documents and then a token prefix of the next epoch. An epoch is
the order of md5(seed, epoch, doc_id). The prefix ends with the document that reaches the budget.
To find it without sorting a whole leaf in one task, the tokens of a leaf are first summed by the
first digits of the hash (``16 ** DIGITS`` slots); only the slot in which the budget ends is sorted.

Defined results: null domain, language or source is the group ''. A null text has no tokens; a null id
counts as ''. Documents with the same id, or none, tie in the order; the text's hash settles it, and of rows equal
in both as many are taken as the budget needs. Leaves without a positive weight get nothing. A budget above the
capacity of the whole tree takes everything. An empty table gives no rows. Other columns pass
through; columns named like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnlake.llm.common import WORD_PATTERN, stored, table

LEVELS = ("domain", "lang", "source")
DIGITS = 3


def word_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def share_out(children: DataFrame, parent: list[str], budget: str, weight: str, capacity: str, out: str) -> DataFrame:
    """Split ``budget`` of each parent among its children, shortages going to siblings."""
    names = [c for c in children.columns if c not in (budget, weight, capacity)]
    order = Window.partitionBy(*parent).orderBy(F.col(capacity) / F.col(weight), *[n for n in names if n not in parent])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = children.where(F.col(weight) > 0).withColumns(
        {
            "__left": F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0.0)),
            "__weights": F.sum(weight).over(from_here),
        }
    )
    level = F.col("__left") / F.col("__weights")
    return (
        full.withColumn("__full", F.col(capacity) / F.col(weight) <= level)
        .withColumn("__level", F.max(F.when(~F.col("__full"), level)).over(Window.partitionBy(*parent)))
        .withColumn(out, F.when(F.col("__full"), F.col(capacity)).otherwise(F.col(weight) * F.col("__level")))
        .drop("__left", "__weights", "__full", "__level")
    )


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: Column, max_epochs: int) -> DataFrame:
    """Token budget of each leaf; ``leaves`` has the three levels and ``tokens``.

    ``weights`` names the weights of a level's values; a value that is not named has the level's
    weight under ``*``, else 1.
    """

    def weight(level: str) -> Column:
        named = weights.get(level, {})
        found = F.lit(float(named.get("*", 1.0)))
        for value, w in named.items():
            if value != "*":
                found = F.when(F.col(level) == value, F.lit(float(w))).otherwise(found)
        return found

    capacity = (F.col("tokens") * F.lit(max_epochs)).cast("double")
    tree = leaves.where("tokens > 0").withColumn("capacity", capacity)
    for level in LEVELS:
        tree = tree.withColumn(f"w_{level}", weight(level))
    tree = tree.where(" AND ".join(f"w_{level} > 0" for level in LEVELS))
    domains = tree.groupBy("domain", "w_domain").agg(F.sum("capacity").alias("capacity"))
    domains = domains.withColumn("budget", F.least(total, F.sum("capacity").over(Window.partitionBy(F.lit(0)))))
    domains = share_out(domains, [], "budget", "w_domain", "capacity", "domain_budget").select("domain", "domain_budget")
    langs = tree.groupBy("domain", "lang", "w_lang").agg(F.sum("capacity").alias("capacity")).join(domains, "domain")
    langs = share_out(langs, ["domain"], "domain_budget", "w_lang", "capacity", "lang_budget").select("domain", "lang", "lang_budget")
    sources = tree.select("domain", "lang", "source", "w_source", "capacity", "tokens").join(langs, ["domain", "lang"])
    sources = share_out(sources, ["domain", "lang"], "lang_budget", "w_source", "capacity", "leaf_budget")
    return sources.select(*LEVELS, F.col("tokens").alias("leaf_tokens"), F.floor(F.col("leaf_budget") + 1e-6).cast("long").alias("leaf_budget"))


def mix(
    docs: DataFrame,
    weights: dict[str, dict[str, float]],
    share: float,
    domain: Column,
    max_epochs: int = 1,
    seed: int = 0,
    tokens: Column | None = None,
) -> DataFrame:
    """Selected documents with epoch, tokens and domain; a document comes once per epoch that takes it.

    ``share`` is the token budget relative to the tokens of the table.
    """
    tokens = word_tokens() if tokens is None else tokens
    kept = [c for c in docs.columns if c.lower() not in ("domain", "epoch", "tokens")]
    sized = docs.select(
        *kept,
        F.coalesce(domain, F.lit("")).alias("domain"),
        tokens.alias("tokens"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"),
        F.xxhash64("text").alias("__tie"),
    )
    # the texts are read once for the figures and once for the result
    slim = stored(
        sized.select("doc_id", "domain", F.col("__lang").alias("lang"), F.col("__source").alias("source"), "tokens", "__tie"),
        "mixing-sizes",
    )
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    total = F.floor(F.lit(float(share)) * F.sum("capacity").over(Window.partitionBy(F.lit(0))) / max_epochs)
    plan = budgets(leaves, weights, total, max_epochs).select(
        *[F.col(c).alias(f"__p_{c}") for c in LEVELS],
        F.floor(F.col("leaf_budget") / F.col("leaf_tokens")).cast("int").alias("__whole"),
        (F.col("leaf_budget") % F.col("leaf_tokens")).alias("__rest"),
    )
    plan = stored(plan, "mixing-plan")
    leaf = [f"__p_{c}" for c in LEVELS]

    def planned(rows: DataFrame, columns: list[str]) -> DataFrame:
        """Members of the leaves with their place in the begun epoch."""
        name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("__whole").cast("string"), name))
        on = [F.col(a) == F.col(b) for a, b in zip(columns, leaf, strict=True)]
        return rows.join(plan, on).withColumn("__key", key)

    # where the budget of the begun epoch ends: first by slots of the hash, then inside one slot
    begun = planned(slim, list(LEVELS)).where("__rest > 0").withColumn("__slot", F.substring("__key", 1, DIGITS))
    upto = Window.partitionBy(*leaf).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        begun.groupBy(*leaf, "__slot", "__rest")
        .agg(F.sum("tokens").alias("__in_slot"))
        .withColumn("__before", F.coalesce(F.sum("__in_slot").over(upto), F.lit(0)))
        .where("__before < __rest AND __before + __in_slot >= __rest")
        .select(*leaf, "__slot", "__before")
    )
    order = Window.partitionBy(*leaf).orderBy("__key", "__tie")
    inside = order.rowsBetween(Window.unboundedPreceding, -1)
    equal = Window.partitionBy(*leaf, "__key", "__tie")
    last = F.struct("__key", "__tie", (F.row_number().over(order) - F.rank().over(order) + 1).alias("nth"), F.count(F.lit(1)).over(equal).alias("ties"))
    ends = (
        begun.join(edge, [*leaf, "__slot"])
        .withColumn("__sum", F.col("__before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .withColumn("__last", last)
        .where("__sum < __rest")
        .groupBy(*leaf)
        .agg(F.max("__last").alias("__last"))
        .select(*[F.col(c).alias(f"__l_{c}") for c in leaf], "__last")
    )
    ends = stored(ends, "mixing-ends")
    marked = planned(sized, ["domain", "__lang", "__source"]).join(ends, [F.col(c) == F.col(f"__l_{c}") for c in leaf], "left")
    begins = F.col("__rest") > 0
    tied = F.coalesce(begins & (F.col("__key") == F.col("__last.__key")) & (F.col("__tie") == F.col("__last.__tie")), F.lit(False))
    before = F.coalesce(begins & (F.struct("__key", "__tie") <= F.struct("__last.__key", "__last.__tie")), F.lit(False))
    marked = marked.withColumn("__taken", before)
    if not ends.where("__last.nth < __last.ties").isEmpty():
        # the budget ends among equal rows: they alone are numbered
        parted = tied & (F.col("__last.nth") < F.col("__last.ties"))
        number = F.row_number().over(Window.partitionBy(*leaf).orderBy("__tie"))
        some = marked.where(parted).withColumn("__taken", number <= F.col("__last.nth"))
        marked = marked.where(~parted).unionByName(some)
    return (
        marked.where("__whole > 0 OR __taken")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__whole") - 1 + F.col("__taken").cast("int"))))
        .select(*kept, "domain", "tokens", "epoch")
    )


# Parameters of the registered query: four domains of five sources each, English held at half.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "*": 1}, "source": {"*": 1}}
SHARE, MAX_EPOCHS, SEED = 0.6, 3, 8


def source_domain() -> Column:
    """The test tables have no domain: it is the source's number modulo 4."""
    return F.concat(F.lit("d"), (F.coalesce(F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"(\d+)$", 1).try_cast("long"), F.lit(0)) % 4).cast("string"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents mixed to the target weights."""
    mixed = mix(table(spark, folder, "documents"), WEIGHTS, SHARE, source_domain(), MAX_EPOCHS, SEED)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "tokens")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
         'd' || (coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '(\d+)$', 1) AS BIGINT), 0) % 4) AS domain,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens, text
  FROM documents
), leaves AS (
  SELECT domain, l, s, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) * 3 AS capacity,
         CASE domain WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 3.0 WHEN 'd2' THEN 2.0 ELSE 1.0 END::DOUBLE AS wd,
         CASE l WHEN 'en' THEN 5.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END::DOUBLE AS wl, 1.0::DOUBLE AS ws
  FROM sized GROUP BY ALL HAVING sum(tokens) > 0
), d0 AS (
  SELECT domain, wd, sum(capacity) AS cap FROM leaves GROUP BY ALL
), d1 AS (
  SELECT *, least(floor(0.6::DOUBLE * sum(cap) OVER () / 3), sum(cap) OVER ()) AS budget FROM d0
), d2 AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / wd, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(wd) OVER (ORDER BY cap / wd, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM d1
), d3 AS (
  SELECT *, max(CASE WHEN cap / wd > lvl THEN lvl END) OVER () AS shared FROM d2
), d4 AS (
  SELECT domain, CASE WHEN cap / wd <= lvl THEN cap ELSE wd * shared END AS budget FROM d3
), l0 AS (
  SELECT domain, l, wl, sum(capacity) AS cap FROM leaves GROUP BY ALL
), l2 AS (
  SELECT l0.*, (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / wl, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(wl) OVER (PARTITION BY domain ORDER BY cap / wl, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM l0 JOIN d4 USING (domain)
), l3 AS (
  SELECT *, max(CASE WHEN cap / wl > lvl THEN lvl END) OVER (PARTITION BY domain) AS shared FROM l2
), l4 AS (
  SELECT domain, l, CASE WHEN cap / wl <= lvl THEN cap ELSE wl * shared END AS budget FROM l3
), s2 AS (
  SELECT leaves.*, (budget - coalesce(sum(capacity) OVER (PARTITION BY domain, l ORDER BY capacity / ws, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(ws) OVER (PARTITION BY domain, l ORDER BY capacity / ws, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM leaves JOIN l4 USING (domain, l)
), s3 AS (
  SELECT *, max(CASE WHEN capacity / ws > lvl THEN lvl END) OVER (PARTITION BY domain, l) AS shared FROM s2
), s4 AS (
  SELECT domain, l, s, tokens AS leaf_tokens,
         CAST(floor(CASE WHEN capacity / ws <= lvl THEN capacity ELSE ws * shared END + 1e-6) AS BIGINT) AS leaf_budget FROM s3
), p AS (
  SELECT sized.*, leaf_budget // leaf_tokens AS whole_epochs, leaf_budget % leaf_tokens AS rest
  FROM sized JOIN s4 USING (domain, l, s)
), k AS (
  SELECT *, md5('8/' || whole_epochs || '/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM p
), q AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY key, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k
), e AS (
  SELECT *, whole_epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS times FROM q
)
SELECT doc_id, domain, lang, source, CAST(unnest(range(times)) AS INTEGER) AS epoch, CAST(tokens AS BIGINT) AS tokens FROM e
"""
