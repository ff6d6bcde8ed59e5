"""Packing, mixing and URL rules: small cases against plain Python."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnlake.llm import mixing, packing, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = [
    None, "", " ", "a", "a  b", " lead", "trail ", "x\ny z\n\nw", "tab\there", "caf\u00e9 na\u00efve \u00bd 12a", "it's don't",
    "x<|endoftext|>y z", "nbsp\u00a0here now", "the cat sat on the mat. " * 300, "word" * 2000, "\u4f60\u597d \u4e16\u754c",
]


def test_encoder_equals_tokenizer(tokenizer):
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in TEXTS[1:] * 2:  # the second time from the table of parts
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_runs_of_white_space(spark, tokenizer):
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 1_000_000, "a b" + "\n" * 1_200_000 + " c", "x" + "\t \u00a0" * 400_000):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, " " * 1_000_001), (2, "a b")], "doc_id long, text string")
    assert packing.pack(docs).select("doc_id").distinct().count() == 2


def test_pieces_tile_documents_and_windows(spark, tokenizer):
    rows = [(i if i != 3 else None, t, "other") for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(3)
    pieces = packing.pack(docs, block_tokens=4000).toPandas()
    want = {}
    for i, text, _ in rows:
        want.setdefault(i, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    for i, ids in want.items():
        if i is None:
            continue
        mine = pieces[pieces.doc_id == i].sort_values("start")
        at = 0
        for p in mine.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[0])
            part = np.array(ids[0][at : at + p.length], "<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids[0])
    for _, window in pieces.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert (window.offset == window.length.cumsum() - window.length).all()
        assert window.length.sum() <= 2048
    full = pieces.groupby("sequence_id").length.sum()
    assert (~full.isin(packing.TIERS)).sum() <= 2 * 3 + 2  # one rest a block at most


def test_pack_block_fills_all_windows_but_one():
    rng = random.Random(1)
    for _ in range(100):
        lengths = [rng.choice([1, 5, 100, 256, 300, 2048, 5000]) + rng.randint(0, 50) for _ in range(rng.randint(1, 40))]
        windows = packing.pack_block(lengths)
        filled = [sum(n for _, _, n in w) for w in windows]
        assert sum(filled) == sum(lengths)
        assert sum(f not in packing.TIERS for f in filled) <= 1
        groups = packing.balance(windows, packing.TIERS, 4096)
        assert all(t >= f for (t, _), f in zip(groups, filled, strict=True))


def test_pack_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_mix(docs, weights, share, epochs, seed):
    """Top-down water filling and token prefixes, one document after the other."""
    import hashlib

    leaves = {}
    for d in docs:
        leaves.setdefault((d["domain"], d["lang"] or "", d["source"] or ""), []).append(d)
    cap = {k: sum(x["tokens"] for x in v) * epochs for k, v in leaves.items()}
    cap = {k: c for k, c in cap.items() if c}

    def fill(budget, kids):  # {child: (weight, capacity)}
        out, left, open_ = {}, budget, dict(kids)
        while open_:
            total = sum(w for w, _ in open_.values())
            full = {k: c for k, (w, c) in open_.items() if c <= left * w / total}
            if not full:
                return out | {k: left * w / total for k, (w, _) in open_.items()}
            out |= full
            left -= sum(full.values())
            open_ = {k: v for k, v in open_.items() if k not in full}
        return out

    def weight(level, value):
        return weights.get(level, {}).get(value, weights.get(level, {}).get("*", 1))

    def below(prefix):
        n = len(prefix)
        kids = sorted({k[: n + 1] for k in cap if k[:n] == prefix})
        return {k: (weight(mixing.LEVELS[n], k[n]), sum(c for q, c in cap.items() if q[: n + 1] == k)) for k in kids}

    plan = {(): min(int(share * sum(cap.values()) / epochs), sum(cap.values()))}
    for _ in range(3):
        plan = {k: b for p, budget in plan.items() for k, b in fill(budget, below(p)).items()}
    taken = []
    for leaf, budget in plan.items():
        size = cap[leaf] // epochs
        whole, rest = divmod(int(budget + 1e-6), size)
        ordered = sorted(leaves[leaf], key=lambda d: hashlib.md5(f"{seed}/{whole}/{d['doc_id']}".encode()).hexdigest())
        before = 0
        for d in ordered:
            taken += [(d["doc_id"], e) for e in range(whole + (before < rest))]
            before += d["tokens"]
    return sorted(taken)


def test_mix_against_plain(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        source = rng.choice(["s1"] * 8 + ["s2", "s3", None])
        text = rng.choice([None, "", "one two three " * rng.randint(1, 30)])
        rows.append((i, text, rng.choice(["en", "en", "de", None]), source, "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string")
    plain = [{"doc_id": i, "tokens": len((t or "").split()), "lang": g, "source": s, "domain": "d1" if s == "s1" else "d0"} for i, t, g, s, _ in rows]
    domain = F.when(F.col("source") == "s1", "d1").otherwise("d0")
    weights = {"domain": {"d0": 3, "d1": 1}, "lang": {"en": 2, "*": 1}, "source": {"s3": 2, "*": 1}}
    for share, epochs in ((0.5, 1), (0.9, 2), (5.0, 2)):
        got = mixing.mix(docs, weights, share, domain, epochs, 7)
        assert sorted((r.doc_id, r.epoch) for r in got.select("doc_id", "epoch").collect()) == plain_mix(plain, weights, share, epochs, 7)
    assert mixing.mix(docs.limit(0), weights, 0.5, domain).count() == 0


def test_mix_keeps_its_budget_with_null_and_repeated_ids(spark):
    rows = [(None if i % 10 else i, "one two three four five", "en", "s") for i in range(400)]
    rows += [(7, "one two three four five", "en", "s")] * 300 + [(8, f"w{i} two three four five", "en", "s") for i in range(300)]
    docs = spark.createDataFrame([(*r, i, i, "c") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, Epoch int, TOKENS int, Domain string")
    for share in (0.1, 0.3, 0.5, 0.77, 0.95):
        got = mixing.mix(docs.repartition(5), {}, share, F.lit("d"))
        budget = int(share * 5 * len(rows))
        taken = got.agg(F.sum("tokens")).first()[0]
        assert budget <= taken < budget + 5
    got = mixing.mix(docs, {}, 1.3, F.lit("d"), max_epochs=2)
    assert 0 <= got.agg(F.sum("tokens")).first()[0] - int(1.3 * 5 * len(rows)) < 5


URLS = [
    None, "", "no scheme", "http://", "http://example.com", "https://WWW.Example.COM/en/x?q#f", "http://a.b.example.com/en/", "http://example.com/EN/",
    "http://x.net/es/1", "http://net/fr/", "http://x.net/frog", "http://com/", "http://telecom/", "http://a.com:80/", "ftp://q.example.com/en/a://b",
    "http://example.com/en", "http://x.com\n/en/", "http://.com/x",
]


def plain_verdict(url, rules):
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_rules_by_trie_and_by_join(spark):
    texts = [*url_filter.RULES, "block x.com/", "allow x.com/", "block example.com/en", "allow com/e", "block a.b.example.com"]
    rules = [url_filter.Rule.parse(t) for t in texts]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    want = sorted((i, *plain_verdict(u, rules)) for i, u in enumerate(URLS * 2))
    for bound in (100, 0):
        got = url_filter.judge(pages, rules, trie_rules=bound).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == want, json.dumps(want)
    assert {r.verdict for r in url_filter.judge(pages, [], default="block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
