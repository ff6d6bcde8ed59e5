"""URL rules in a trie over reversed host labels and path segments.

A rule has a host and a path. It fits a url whose host is the rule's or a subdomain of it and whose
path starts with the rule's path, character by character. Of the rules that fit, the one with the
most host labels wins, then the one with the longest path; of an allow and a block rule for the same
host and path, block wins. Without a rule the verdict is ``default``.

The trie is broadcast only if the rules are within ``TRIE_RULES`` and ``TRIE_BYTES``; a larger list
goes through an equi-join on (host suffix, path up to a slash) instead, with the same result.

Defined results: a null url, or one without ``://``, has an empty host and path, and no rule fits
it. Repeated rules count once. Empty tables and an empty rule list are valid. Other columns of the
url table pass through; result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnlake.llm.common import fresh, table

TRIE_RULES = 200_000
TRIE_BYTES = 16 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @classmethod
    def parse(cls, text: str) -> Rule:
        """From ``block example.com/en/``."""
        verdict, place = text.split(" ", 1)
        if verdict not in ("allow", "block"):
            raise ValueError(f"neither allow nor block: {text}")
        host, slash, rest = place.partition("/")
        return cls(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + rest)

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Node:
    """One host label or path segment; ``ends`` has the rules that end within the next segment."""

    below: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None  # at a host node: the root of its paths
    ends: dict[str, Rule] = field(default_factory=dict)
    sizes: tuple[int, ...] = ()  # lengths of the keys of ends, longest first


class Trie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, Node())
            if node.paths is None:
                node.paths = Node()
            node = node.paths
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.below.setdefault(segment, Node())
            if last not in node.ends or rule.verdict == "block":
                node.ends[last] = rule
            node.sizes = tuple(sorted({*map(len, node.ends)}, reverse=True))

    def find(self, host: str, path: str) -> Rule | None:
        """The winning rule: deepest host node with a fitting path, there the longest path."""
        node, hosts = self.root, []
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths is not None:
                hosts.append(node.paths)
        segments = path.split("/")
        for node in reversed(hosts):
            best = None
            for segment in segments:
                for size in node.sizes:
                    if size <= len(segment) and (rule := node.ends.get(segment[:size])):
                        best = rule
                        break
                node = node.below.get(segment)
                if node is None:
                    break
            if best is not None:
                return best
        return None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without a scheme."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, URL_PATTERN, 1), UPPER, LOWER)
    return host, F.regexp_extract(text, URL_PATTERN, 2)


def judge(
    pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow",
    trie_rules: int = TRIE_RULES, trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    host, path = host_and_path(F.col(url))
    kept = [F.col(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    small = len(rules) <= trie_rules and sum(len(r.text) for r in rules) <= trie_bytes
    judged = _by_trie(parts, rules) if small else _by_join(parts, rules)
    found = fresh(pages, "found")
    judged = judged.withColumnRenamed("__found", found)
    return judged.select(
        *[c for c in judged.columns if c != found],
        F.col(found)["rule"].alias("rule"),
        F.coalesce(F.col(found)["verdict"], F.lit(default)).alias("verdict"),
    )


FOUND = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def _by_trie(parts: DataFrame, rules: list[Rule]) -> DataFrame:
    shared = parts.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf(FOUND)
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for hosts, paths in batches:
            found = [trie.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(
                {"rule": [r and r.text for r in found], "verdict": [r and r.verdict for r in found]}, dtype=object
            )

    return parts.withColumn("__found", look_up("host", "path"))


def _by_join(parts: DataFrame, rules: list[Rule]) -> DataFrame:
    """For lists beyond the broadcast bound: distinct (host, path) pairs meet the rules on equal keys."""
    spark = parts.sparkSession
    rows = [(r.host, r.path[: r.path.rfind("/") + 1], r.path, r.text, r.verdict) for r in rules]
    known = spark.createDataFrame(rows, "r_host string, r_stem string, r_path string, rule string, verdict string")
    pairs = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.split("path", "/")
    stems = F.transform(
        F.sequence(F.lit(0), F.size(segments) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/"))),
    )
    keys = pairs.select("host", "path", F.explode(suffixes).alias("r_host"), stems.alias("stems"))
    keys = keys.select("host", "path", "r_host", F.explode("stems").alias("r_stem"))
    rank = F.struct(
        F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("size"), (F.col("verdict") == "block").alias("block")
    )
    best = (
        keys.join(known, ["r_host", "r_stem"])
        .where(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), rank).alias("__found"))
    )
    return parts.join(best, ["host", "path"], "left").select(*parts.columns, "__found")


# The rules of the registered query.
RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every url of pages judged by the rules."""
    rules = [Rule.parse(r) for r in RULES]
    return judge(table(spark, folder, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
)
SELECT page_id, host, path,
       CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule,
       CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'allow'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'block'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND (starts_with(path, '/es/') OR starts_with(path, '/fr/')) THEN 'block'
            ELSE 'allow' END AS verdict
FROM parts
"""
