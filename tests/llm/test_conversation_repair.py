"""Conversation repair against a search over all edit strings and a plain re-count."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from firnlake.llm import conversation_repair, repair_dp

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def edits_of(rows):
    """Cheapest, then ASCII-least edits by Dijkstra over (cost, string, place, initials written)."""
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, at, last = heapq.heappop(queue)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        ok = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for new in ok.replace("s", ""):
            heapq.heappush(queue, (cost + 5, audit + "I", at, new))
            if at < len(rows):
                initial, must_go, cut = rows[at]
                if not must_go:
                    heapq.heappush(queue, (cost + 1 + 5 * cut, audit + "R", at + 1, new))
        if at < len(rows):
            initial, must_go, cut = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, last))
            if not must_go and initial and initial in ok:
                heapq.heappush(queue, (cost + 5 * cut, audit + "K", at + 1, initial))
    raise AssertionError


def plain(rows):
    """The contract, one conversation after the other."""
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    kept = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in kept if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = edits_of([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
        written, last, at = [], "", 0
        for e in audit:
            new = "a" if last == "u" else "u"
            if e == "I":
                written.append({"u": "user:", "a": "assistant:"}[new])
                last = new
                continue
            _, role, text = mine[at]
            at += 1
            if e == "K":
                written.append(f"{role}:{text}")
                last = role[0]
            elif e == "R":
                written.append({"u": "user", "a": "assistant"}[new] + ":" + text)
                last = new
        sha = hashlib.sha256("\n".join(written).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def repaired(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversation_repair.repair(conversation_repair.damaged(df), df, **kwargs).collect()
    assert len(found) == len({r[0] for r in found})
    return {r[0]: tuple(r[1:]) for r in found}


def conversations(seed, count, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hello.", "Why?", "cut off", "", " \n", None, "Yes!\t", f"turn {turn}.", f"open {turn}", "ü.", " ", "end ."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, text))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 3), (3, 1)])
def test_against_a_search_over_all_edits(spark, seed, block):
    rows = conversations(seed, 120, 14)
    rows += [(None, 1, "user", "No id."), (None, None, "assistant", "None.")] + rows[:40]
    assert repaired(spark, rows, block_rows=block) == plain(rows)


def test_one_long_conversation_in_many_tasks(spark):
    rng = random.Random(9)
    rows = [(7, t // 3, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Text {t}.", f"open {t}", ""])) for t in range(700)]
    rows += [(8, 5, "user", "Again.")] * 300
    assert repaired(spark, rows, block_rows=50) == plain(rows)


def test_all_rows_lost_empty_table_and_clashing_columns(spark):
    lost = [(c, 0, "user", "Gone.") for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    assert repaired(spark, lost) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in lost}
    assert repaired(spark, []) == {}
    rows = conversations(4, 6, 6)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, n long, conv string, kind int")
    found = conversation_repair.repair(conversation_repair.damaged(df), df)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == plain(rows)


def test_given_tables(spark, sf):
    from firnlake.llm.common import table

    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = conversation_repair.op11_conversation_repair(spark, sf).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == plain(rows)


@pytest.mark.parametrize("prime", [repair_dp.PRIME, 7, 2])
def test_comparison_of_paths_with_collisions(prime):
    rng = random.Random(prime)
    paths = repair_dp.Paths(prime)
    nodes = [0]
    for _ in range(300):
        nodes.append(paths.add(rng.choice(nodes[-12:]), rng.choice("DIKR")))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert paths.less(a, b) == (paths.text(a) < paths.text(b))


def test_blocks_chain_to_the_whole():
    rng = random.Random(11)
    for _ in range(300):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(12))]
        want = edits_of(rows)
        for size in (1, 2, 5, 20):
            tables = []
            for at in range(0, len(rows), size):
                block = repair_dp.Block(prime=7)
                for row in rows[at : at + size]:
                    block.add(*row)
                tables.append(block.table())
            assert repair_dp.chained(tables) == want
