"""Near duplicates, repeated strings, suffix sorting and archives: against brute force."""

import base64
import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from firnlake.llm import dart_minhash, suffix_dedup, warc
from firnlake.llm.induced_sort import sorted_suffixes


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    for shared in (270, 240, 150):
        equal, true = [], []
        for _ in range(30):
            a = rng.integers(0, 2**63, 300).astype(np.uint64)
            w = rng.integers(1, 6, 300).astype(float)
            b, v = a.copy(), w.copy()
            b[shared:] = rng.integers(0, 2**63, 300 - shared).astype(np.uint64)
            v[:20] += 2
            least = np.minimum(w[:shared], v[:shared]).sum()
            true.append(least / (w.sum() + v.sum() - least))
            equal.append((dart_minhash.signature(a, w) == dart_minhash.signature(b, v)).mean())
        assert abs(np.mean(equal) - np.mean(true)) < 0.02


def plain_classes(rows):
    tags = [set(dart_minhash.occurrence_tags(dart_minhash.shingles(t or "")).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(tags[i] & tags[j])
            same = (rows[i][1] or "") == (rows[j][1] or "") or rows[i][0] == rows[j][0]
            if same or n and n >= 0.8 * (len(tags[i]) + len(tags[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [min(rows[k][0] for k in range(len(rows)) if top(k) == top(i)) for i in range(len(rows))]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(6, 150))) for _ in range(25)]
    texts = [None, "", "", "one two", "one two", "One  Two", "a b c d e"] + base
    for b in base[:15]:
        words = b.split()
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                copy[rng.randrange(len(copy))] = "zz"
            texts.append(" ".join(copy))
    texts += ["same line again " * 40, "same line again " * 41, "same line again " * 70]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)] + [(0, texts[order[0]]), (7, "a text of its own with the id of another one")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, key string").repartition(5)
    got = dart_minhash.near_duplicates(docs)
    assert got.count() == len(rows)
    want = Counter(zip([r[0] for r in rows], plain_classes(rows), strict=True))
    assert Counter((r.id, r.class_id) for r in got.collect()) == want
    kept = dart_minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})
    assert dart_minhash.deduplicate(docs.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, "x y"), (None, "x y"), (None, "z")], "doc_id long, text string")
    assert dart_minhash.deduplicate(lost).count() == 2


def test_odd_ids_keep_their_texts(spark):
    """Negative and null ids, and two texts under one id with a near copy of each."""
    rng = random.Random(14)

    def text(seed):
        return " ".join(f"w{random.Random(seed * 1000 + i).randrange(500)}" for i in range(120))

    def near(t):
        words = t.split()
        words[rng.randrange(120)] = "other"
        return " ".join(words)

    one, two = text(1), text(2)
    rows = [(1, one), (1, two), (2, near(one)), (3, near(two)), (-5, text(3)), (-9, near(text(3))), (None, text(4)), (None, near(text(4))), (None, text(3)), (40, text(5))]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, kept_id int, __copies int, node int")
    got = Counter((r.id, r.class_id) for r in dart_minhash.near_duplicates(docs).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (-5, -9), (-9, -9), (None, -9), (None, None), (None, None), (40, 40)])
    kept = dart_minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, -9, None, 40])


@pytest.mark.parametrize("memory,base", [(1 << 20, 1 << 20), (4, 2)])
def test_induced_sort_against_plain_sort(memory, base):
    rng = random.Random(7)
    for _ in range(250):
        n = rng.randint(1, 60)
        text = [rng.randint(0, rng.randint(1, 5)) for _ in range(n)]
        if rng.random() < 0.3:
            text = (text[: rng.randint(1, 7)] * 20)[:n]
        chunks = list(sorted_suffixes(np.array(text, dtype=np.uint16), 1000, memory=memory, base=base))
        order = np.concatenate([c[0] for c in chunks])[::-1].tolist()
        common = np.concatenate([c[1] for c in chunks])[::-1].tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        for a, b, k in zip(order, order[1:], common, strict=False):
            assert text[a : a + k] == text[b : b + k] and text[a + k : a + k + 1] != text[b + k : b + k + 1]


def test_induced_sort_takes_few_bytes_a_letter():
    """A worker sorts shards of some MB beside what the executor holds; blocks of all pairs and 8-byte places took over 100."""
    rng = np.random.default_rng(3)
    vocabulary = [bytes(rng.integers(97, 123, rng.integers(2, 10), dtype=np.uint8)) for _ in range(3000)]
    words = b" ".join(vocabulary[i] for i in np.minimum(rng.zipf(1.3, 200_000), 3000) - 1)
    text = np.frombuffer(words, dtype=np.uint8).astype(np.uint16)
    tracemalloc.start()
    try:
        found = sum(len(s) for s, _ in sorted_suffixes(text, 400))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == len(text) and peak < 75 * len(text)


def test_words_are_coded_where_segments_are_found(spark):
    """One Python worker a task, and the segments of the codes are those of the codes made beforehand."""
    rows = spark.createDataFrame([(i, 7, " ".join(f"w{j * i % 90}" for j in range(50 * i)).encode()) for i in range(1, 6)], "id long, tie long, bytes binary")
    found = suffix_dedup.find_segments(rows, 306, 122, coded=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    codes = suffix_dedup._codes(pa.array([r.bytes for r in rows.orderBy("id").collect()], pa.binary()))
    assert [len(c) for c in codes] == [300 * i for i in range(1, 6)]
    made = spark.createDataFrame([(i, 7, c) for i, c in enumerate(codes, 1)], "id long, tie long, bytes binary")
    want = Counter(map(tuple, suffix_dedup.find_segments(made, 306, 122).collect()))
    assert want and Counter(map(tuple, found.collect())) == want


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d), dtype=bool)
        for p in range(len(d) - length + 1):
            if count[d[p : p + length]] > 1:
                cover[p : p + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~cover])
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out.append((len(d), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_against_brute_force(spark, hot, monkeypatch):
    rng = random.Random(8)
    shared = ["".join(rng.choice("abc \u00e9") for _ in range(n)) for n in (30, 45, 70, 200)]
    texts = [None, "", "a" * 39, "a" * 300, "ab" * 100, "x\0y" * 30, "b" * 40]
    for _ in range(60):
        texts.append("".join(rng.choice([*shared, "".join(rng.choice("defg") for _ in range(rng.randint(1, 60)))]) for _ in range(rng.randint(1, 8))))
    texts += [texts[20], texts[21]]
    rows = [(i if i else None, t, "c") for i, t in enumerate(texts)] + [(20, texts[20], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie string").repartition(4)
    got = suffix_dedup.repeat_report(docs, length=40, gram=12, hot=hot, shard_bytes=2000)
    want = Counter((r[0], *p) for r, p in zip(rows, plain_repeats([r[1] for r in rows], 40), strict=True))
    assert Counter(map(tuple, got.collect())) == want
    cut = suffix_dedup.remove_repeats(docs, length=40, gram=12, hot=hot)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert suffix_dedup.repeat_report(docs.limit(0)).count() == 0


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 100)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd") for _ in range(1000)).encode() for _ in range(3)]
    texts.append(texts[0][150:420] + texts[1][:90])
    for data, owners, placed in suffix_dedup._blocks(enumerate(texts), 40):
        begin, starts, _, _ = suffix_dedup.segments(data, owners, 40, 12, suffix_dedup._hashers(40))
        covered = sorted((placed[owners[b]][0], b - placed[owners[b]][1] + placed[owners[b]][2] + i) for b, n in zip(begin, starts, strict=True) for i in range(n))
        assert len(covered) == len(set(covered))


def test_many_equal_rows(spark):
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    rows = [(None, text)] * 400 + [(1, text[5000:9000]), (2, "z" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, suffix_dedup.repeat_report(docs).collect()))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got == Counter({(None, 20_000, 20_000, 1, nothing): 400, (1, 4000, 4000, 1, nothing): 1, (2, 300, 0, 0, hashlib.sha256(b"z" * 300).hexdigest()): 1})


def test_regions_keep_all_segments_that_share_a_string():
    rng = random.Random(13)
    length, gram = 80, 32
    hasher = suffix_dedup.Hasher(4000, 1)
    kept = lost = 0
    for _ in range(200):
        piece = "".join(rng.choice("abcd") for _ in range(gram))
        parts = []
        around = "".join(rng.choice("abcd") for _ in range(200)) + piece + "".join(rng.choice("abcd") for _ in range(200))
        for _ in range(5):
            left, right = rng.randrange(0, length - gram + 1), rng.randrange(0, length - gram + 1)
            before, after = rng.randrange(0, length - gram + 1), rng.randrange(0, length - gram + 1)
            body = around[200 - left : 200 + gram + right]
            body = "".join(rng.choice("efgh") for _ in range(before)) + body + "".join(rng.choice("efgh") for _ in range(after))
            parts.append(body.encode())
        data = np.frombuffer(piece.encode(), dtype=np.uint8)
        anchor = int(hasher.between(hasher.prefix(data), np.array([0]), np.array([gram])).view(np.int64)[0])
        hit = suffix_dedup.may_repeat([(anchor, x) for x in parts], length, gram, hasher)
        strings = [{x[i : i + length] for i in range(len(x) - length + 1) if piece.encode() in x[i : i + length]} for x in parts]
        for i, mine in enumerate(strings):
            shares = any(mine & other for j, other in enumerate(strings) if j != i)
            assert hit[i] or not shares
            kept, lost = kept + (hit[i] and not shares), lost + (not hit[i])
    assert lost > 2 * kept


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(10)
    bodies = ["<p>one</p>", "<p>two \u00e9</p>", "", None, "x" * 5000]
    rows = []
    for i in range(120):
        url = rng.choice([None, "", "no scheme", f"http://h{i % 4}.example.com/p?q={i}", "https://Same.example.org/x y\n", '"quoted"'])
        rows.append((i - 3, url, rng.choice([*bodies, f"<p>{i}</p>"]), "c"))
    rows += [rows[50], rows[51], (None, "http://null.org/", "<p>one</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(4)
    for least in (0, 6):
        place = str(tmp_path / f"w{least}")
        captures = warc.write_archives(pages, place, min_bytes=least)
        parts = warc.write_index(captures, place, block_lines=5, part_lines=40)
        keys = pages.select(warc.capture_key(pages["url"], pages["page_id"]).alias("key"))
        got = warc.read_records(warc.find_captures(keys, parts, place), place).collect()
        first = {}
        for i, _, html, _ in rows:
            if i is not None and len((html or "").encode()) >= least:
                first[html or ""] = min(first.get(html or "", i), i)
        want = []
        for i, url, html, _ in rows:
            data = (html or "").encode()
            refers = first.get(html or "") if len(data) >= least else None
            refers = None if refers == i else refers
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            want.append((i, len(data), digest, "response" if refers is None else "revisit", refers, url))
        assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    place = str(tmp_path / "none")
    captures = warc.write_archives(pages.limit(0), place)
    parts = warc.write_index(captures, place)
    assert captures.count() == 0 and parts.count() == 0
    assert warc.read_records(warc.find_captures(keys, parts, place), place, 0).count() == 0


def test_pairs_inside_a_large_template_group(spark):
    rng = random.Random(21)
    template = [f"t{i}" for i in range(500)]
    count = iter(range(10**9))

    def own(n):
        return [f"o{next(count)}" for _ in range(n)]

    texts = [template + own(80) for _ in range(300)]
    for _ in range(200):  # 0.82 to each other, 0.756 to all others
        both = own(24)
        texts += [template + both + own(56) for _ in range(2)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(order[i], " ".join(t)) for i, t in enumerate(texts)]
    want = {order[i]: order[i] for i in range(300)}
    for i in range(300, len(texts), 2):
        want[order[i]] = want[order[i + 1]] = min(order[i : i + 2])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()}
    assert got == want
