"""Near-duplicate classes by DartMinHash signatures and a banded join.

A document is the weighted set of its five-word shingles, weighted by their number of occurrences.
Darts are thrown by hashing: each element has regions of the weight axis (0 to 1, 1 to 2, 2 to 4,
...), and each region a hash-driven Poisson process of darts along the rank axis, with intensity the
region's width; a dart has a random weight inside its region and a random coordinate. The document
is hit by the darts whose weight lies below the element's weight. A coordinate of the signature is
the earliest dart that hits it; two documents share it with probability equal to their weighted
Jaccard similarity. Only ranks up to (k ln k + 2k) / total weight are looked at, in which all k
coordinates are hit almost always (else the bound is doubled), so the work is the number of elements
plus k log k, whatever the weights.

Equal texts become one node first. ``BANDS`` bands of ``ROWS`` coordinates give buckets; in each
bucket the nodes are compared with its smallest and largest node, not with each other. Where that
leaves nodes of a bucket in different classes, all pairs of such nodes that can still be alike are
found exactly, by their rare shingles: with shingles in one order for all texts, rare ones first, two
texts that share ``o`` of their ``n`` and ``m`` shingles have a common one among the first n - o + 1
and m - o + 1. A template shared by thousands of unlike texts lies behind those places, so it makes no
pairs. Shingles are ordered by counts of hash slots; slots that mix shingles cost time, not pairs.
Every comparison is an exact weighted Jaccard similarity of at least ``SIMILARITY``. Classes are
connected components.

Buckets and copies are summed in each task before the shuffle and joined back on their key, where
AQE splits hot keys; no bucket is gathered in one task and no link reaches the driver.

Defined results: words are lower-cased runs of non-white characters. Texts of fewer than five words
are one shingle; texts without words are only like their exact copies; a null text is empty. The
class id is the smallest doc_id of the class, null if it has none. Rows that repeat an id are one document,
linked by any of their texts; rows with a null id are linked by their texts alone. Empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnlake.llm.common import fresh, stored, table, text_or_empty

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
KEPT_WORDS = 60_000
SLOTS = 1 << 20

_U = np.uint64


# -- hashing ----------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _times(number: int, factor: int) -> np.uint64:
    return _U(number * factor & 0xFFFFFFFFFFFFFFFF)


def _unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


class Words(dict):
    """Hash of a word; the table is bounded, later words are hashed anew."""

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) < KEPT_WORDS and len(word) < 64:
            self[word] = value
        return value


_WORDS = Words()


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles in text order."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return out


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(hashes, return_counts=True)
    return values, counts.astype(np.float64)


def occurrence_tags(hashes: np.ndarray) -> np.ndarray:
    """A set whose Jaccard similarity is the weighted one: (shingle, number of its occurrence)."""
    ordered = np.sort(hashes)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, dtype=np.int64)
    nth = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return np.unique(np.where(nth == 0, ordered, _mix(ordered + nth.astype(np.uint64) * _U(0xD1342543DE82EF95))))


# -- darts ------------------------------------------------------------------------------------


def _regions(elements: np.ndarray, weights: np.ndarray):
    """Keys, begin, width and element weight of the regions that start below the elements' weights."""
    keys, begins, widths, tops = [_mix(elements)], [np.zeros(len(elements))], [np.ones(len(elements))], [weights]
    begin, level = 1.0, 1
    while True:
        inside = weights > begin
        if not inside.any():
            break
        keys.append(_mix(elements[inside] + _times(level, 0xA0761D6478BD642F)))
        begins.append(np.full(inside.sum(), begin))
        widths.append(np.full(inside.sum(), begin))
        tops.append(weights[inside])
        begin, level = begin * 2, level + 1
    return tuple(np.concatenate(x) for x in (keys, begins, widths, tops))


def _thrown(keys: np.ndarray, widths: np.ndarray, bound: float):
    """Region, dart hash and rank of all darts with a rank below ``bound``."""
    regions, darts, ranks = [], [], []
    if bound < 4:  # few darts per region: one at a time, for the regions that still have some
        index, rank, nth = np.arange(len(keys)), np.zeros(len(keys)), 0
        while len(index):
            nth += 1
            dart = _mix(keys[index] + _times(nth, 0xE7037ED1A0B428DB))
            rank = rank - np.log(_unit(dart)) / widths[index]
            hit = rank < bound
            index, rank = index[hit], rank[hit]
            regions.append(index)
            darts.append(dart[hit])
            ranks.append(rank)
    else:
        index, rank, nth = np.arange(len(keys)), np.zeros(len(keys)), 0
        while len(index):  # many: a block of darts of every region
            mean = bound * widths[index].max()
            block = int(mean + 6 * mean**0.5 + 8) if nth == 0 else 64
            numbers = np.arange(nth + 1, nth + block + 1, dtype=np.uint64)
            dart = _mix(keys[index][:, None] + numbers[None, :] * _U(0xE7037ED1A0B428DB))
            at = rank[:, None] + np.cumsum(-np.log(_unit(dart)) / widths[index][:, None], axis=1)
            row, column = np.nonzero(at < bound)
            regions.append(index[row])
            darts.append(dart[row, column])
            ranks.append(at[row, column])
            more = at[:, -1] < bound
            index, rank, nth = index[more], at[more, -1], nth + block
    return np.concatenate(regions), np.concatenate(darts), np.concatenate(ranks)


def signature(elements: np.ndarray, weights: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The earliest dart of every coordinate."""
    keys, begins, widths, tops = _regions(elements, weights)
    bound = (coordinates * np.log(coordinates) + 2 * coordinates) / weights.sum()
    while True:
        region, dart, rank = _thrown(keys, widths, bound)
        place = _mix(dart ^ _U(0x8EBC6AF09C88C6E3))
        height = begins[region] + _unit(place) * widths[region]
        hit = height <= tops[region]
        dart, rank = dart[hit], rank[hit]
        order = np.argsort(rank, kind="stable")
        coordinate = _mix(dart + _U(0x589965CC75374CC3)) % _U(coordinates)
        found, first = np.unique(coordinate[order], return_index=True)
        if len(found) == coordinates:
            return dart[order[first]]
        bound *= 2


def bands(text: str) -> np.ndarray | None:
    """Band hashes of a text, or None without words."""
    hashes = shingles(text)
    if not len(hashes):
        return None
    rows = signature(*weighted(hashes)).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + rows[:, i])
    return out.view(np.int64)


# -- Spark ------------------------------------------------------------------------------------


def _with_keys(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.md5(text).alias("key"), text.alias("text"))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, texts = batch.columns
        known: dict[str, np.ndarray | None] = {}
        out = []
        for key, text in zip(keys.to_pylist(), texts, strict=True):
            if key not in known:
                known[key] = bands(text.as_py())
            out.append(known[key])
        yield pa.RecordBatch.from_arrays([ids, keys, pa.array(out, pa.list_(pa.int64()))], names=["id", "key", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [occurrence_tags(shingles(t.as_py())).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "tags"])


def _stars(rows: DataFrame, bucket: str) -> DataFrame:
    """(bucket, node, lo, hi) of buckets with several nodes; centers are those of the smallest and the largest id.

    The smallest id of a group of copies is often the text the others were made of, which is near all of them.
    """
    order = F.struct("least", "node")
    ends = rows.groupBy(bucket).agg(F.min(order)["node"].alias("lo"), F.max(order)["node"].alias("hi")).where("lo <> hi")
    return rows.join(ends, bucket).select(bucket, "node", "lo", "hi")


def _pairs(stars: DataFrame) -> DataFrame:
    return stars.select(F.explode(F.array(F.struct("node", F.col("lo").alias("center")), F.struct("node", F.col("hi").alias("center")))).alias("p")).select(
        F.least("p.node", "p.center").alias("a"), F.greatest("p.node", "p.center").alias("b")
    ).where("a < b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose weighted Jaccard similarity is high enough."""
    one = sets.select(F.col("node").alias("a"), F.col("tags").alias("tags_a"))
    two = sets.select(F.col("node").alias("b"), F.col("tags").alias("tags_b"))
    n_a, n_b = F.size("tags_a"), F.size("tags_b")
    both = pairs.join(one, "a").join(two, "b").where(F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b))
    shared = F.size(F.array_intersect("tags_a", "tags_b"))
    return both.withColumn("shared", shared).where(F.col("shared") >= similarity * (n_a + n_b - F.col("shared"))).select("a", "b")


def _tag_counts(sets: DataFrame) -> np.ndarray:
    """How many nodes have a shingle of each hash slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            tags = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts += np.bincount((tags & _U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])

    summed = sets.select("tags").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    return counts


def _possible_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs of nodes with different roots that can be alike; ``sets`` has node, root and tags."""
    shared = sets.sparkSession.sparkContext.broadcast(_tag_counts(sets))
    part = similarity / (1 + similarity)  # of both sizes: the least number of common tags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            out = []
            for node, root, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tags = listed.values.to_numpy(zero_copy_only=False).view(np.uint64)
                n = len(tags)
                wide = n - int(np.ceil(similarity * n - 1e-6)) + 1  # beside the least partner; beside an equal or larger one:
                narrow = n - int(np.ceil(2 * part * n - 1e-6)) + 1
                first = tags[np.lexsort((tags, counts[tags & _U(SLOTS - 1)]))[:wide]]
                place = np.arange(len(first))
                out.append((first.view(np.int64), np.full(len(first), node), np.full(len(first), root), np.full(len(first), n), place, place < narrow))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["tag", "node", "root", "n", "place", "narrow"]
                )

    tags = stored(sets.mapInArrow(run, "tag long, node long, root long, n int, place int, narrow boolean"), "dart-tags")
    ends = tags.groupBy("tag").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("narrow").alias("any"))
    ends = stored(ends.where("lo < hi AND any").select("tag"), "dart-ends")
    tags = stored(tags.join(ends, "tag"), "dart-tags")
    one = tags.where("narrow").select("tag", *[F.col(c).alias(f"{c}_1") for c in ("node", "root", "n", "place")])
    two = tags.select("tag", *[F.col(c).alias(f"{c}_2") for c in ("node", "root", "n", "place")])
    least = F.ceil(F.lit(part) * (F.col("n_1") + F.col("n_2")) - 1e-6)
    met = one.join(two, "tag").where("root_1 <> root_2 AND n_1 <= n_2")
    met = met.where((F.col("place_1") <= F.col("n_1") - least) & (F.col("place_2") <= F.col("n_2") - least))
    return met.select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node of its component."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        hooked = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hooked = stored(hooked, "roots")
        above = hooked.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = hooked.join(above, F.col("root") == F.col("up")).select("node", "old", F.least("root", "top").alias("root"))
        jumped = stored(jumped, "roots")
        if jumped.where("old <> root").isEmpty():
            return jumped.select("node", "root")
        roots = jumped.select("node", "root")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, key, class_id, kept_key) of every row; ``key`` is the md5 of the text.

    ``class_id`` is the smallest id of the class, null if it has none. ``kept_key`` is the key of the text that
    stands for the class: that of the smallest id, then the smallest key.
    """
    rows = _with_keys(docs)
    signed = stored(rows.mapInArrow(_signed, "id long, key string, bands array<long>"), "dart-signatures")
    nodes = signed.groupBy("key").agg(F.min("id").alias("least"), F.first("bands").alias("bands"))
    # a node is a text: rows with one id may hold several
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "dart-nodes")
    banded = nodes.select("node", "least", F.explode("bands").alias("bucket"))
    stars = stored(_stars(banded, "bucket"), "dart-stars")
    pairs = stored(_pairs(stars), "dart-pairs")
    wanted = stars.select("node").distinct().join(nodes.select("node", "least", F.col("key").alias("w_key")), "node")
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["least"]) & (rows["key"] == wanted["w_key"])).select("node", "text")
    sets = stored(texts.mapInArrow(_sets, "node long, tags array<long>").dropDuplicates(["node"]), "dart-sets")
    links = stored(_verified(pairs, sets, similarity), "dart-links")
    links = _with_same_ids(links, signed, nodes)
    roots = components(links)

    # buckets that hold several classes: all pairs of their nodes that can be alike
    def rooted(frame: DataFrame, node: str, name: str) -> DataFrame:
        found = roots.select(F.col("node").alias("r_node"), F.col("root").alias("r_root"))
        return frame.join(found, F.col(node) == F.col("r_node"), "left").withColumn(name, F.coalesce("r_root", node)).drop("r_node", "r_root")

    placed = stored(rooted(stars, "node", "root").select("bucket", "node", "root"), "dart-placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket")
    open_nodes = stored(placed.join(mixed, "bucket").select("node", "root").distinct(), "dart-open")
    if open_nodes.isEmpty():
        return _classes(signed, nodes, roots)
    more = _possible_pairs(open_nodes.join(sets, "node").select("node", "root", "tags"), similarity).join(pairs, ["a", "b"], "left_anti")
    added = stored(_verified(more, sets, similarity), "dart-links")
    if not added.isEmpty():
        roots = components(links.union(added))
    return _classes(signed, nodes, roots)


def _with_same_ids(links: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Also a link between the texts of rows that repeat an id."""
    twice = signed.where("id is not null").groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("id")
    twice = stored(twice, "dart-ids")
    if twice.isEmpty():
        return links
    own = signed.join(twice, "id").join(nodes.select("key", "node"), "key").select("id", "node")
    least = own.groupBy("id").agg(F.min("node").alias("a"))
    return links.union(own.join(least, "id").where("a < node").select("a", F.col("node").alias("b")))


def _classes(signed: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    known = nodes.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("class"))
    placed = stored(signed.select("id", "key").join(known, "key"), "dart-classes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    named = placed.groupBy("class").agg(first).select("class", F.col("first.id").alias("class_id"), F.col("first.key").alias("kept_key"))
    named = stored(named, "dart-names")
    return placed.join(named, "class").select("id", "key", "class_id", "kept_key")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class."""
    id_, key, copies = (fresh(docs, f"kept_{c}") for c in ("id", "key", "copies"))
    classes = near_duplicates(docs, similarity)
    kept = classes.where("id <=> class_id AND key = kept_key").groupBy("id", "key").agg(F.count(F.lit(1)).alias(copies))
    kept = stored(kept.select(F.col("id").alias(id_), F.col("key").alias(key), copies), "dart-kept")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.md5(text_or_empty()) == F.col(key))
    found = docs.join(kept, same)
    if kept.where(F.col(copies) > 1).isEmpty():
        return found.select(*docs.columns)
    single = found.where(F.col(copies) > 1).dropDuplicates([id_, key])
    return found.where(F.col(copies) == 1).select(*docs.columns).union(single.select(*docs.columns))


def op3_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document."""
    classes = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return classes.select(F.col("id").alias("doc_id"), "class_id")
