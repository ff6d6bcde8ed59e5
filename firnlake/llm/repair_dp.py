"""The cheapest edits of a run of conversation rows, by a persistent dynamic program.

Role initials must read ``(s?(ua)+)?``. Four states say what was written last: ``START`` nothing, ``SYSTEM`` s,
``USER`` u, ``ASSISTANT`` a. A state and the letters of the edits (Keep, Rerole, Delete, Insert) fix what is
written, since a state has one legal role to insert or to change to.

Edit strings are paths in a shared tree: a node has its letter, its depth, its ancestors at distances 1, 2,
4, ... and a rolling hash of the string from the root. Among strings of equal cost the ASCII-least counts.
Two strings are compared at their longest common prefix, which is found by halving steps up the ancestors while
hashes differ; equal hashes are then verified letter by letter down to a node that both share, and strings
are compared plainly if a collision shows up.

Equal cost and equal state mean equally many rows, and neither string can begin with the other (the rest
would be insertions, which cost). So the lesser prefix stays the lesser whatever follows.
"""

from __future__ import annotations

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ACCEPTED = (START, ASSISTANT)

# The costs of the edits.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # after an insertion or a new role
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}

PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


class Paths:
    """A growing tree of letters."""

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]

    def add(self, parent: int, letter: str) -> int:
        ancestors, at, i = [parent], parent, 0
        while i < len(self.up[at]):
            at = self.up[at][i]
            ancestors.append(at)
            i += 1
        self.up.append(tuple(ancestors))
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % self.prime)
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        rest = self.depth[node] - depth
        while rest:
            step = rest.bit_length() - 1
            node = self.up[node][step]
            rest -= 1 << step
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _same(self, a: int, b: int) -> bool:
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        for step in range(max(0, depth.bit_length()), -1, -1):
            # both are at one depth, so they have equally many ancestors
            if step < len(self.up[x]) and self.hash[self.up[x][step]] != self.hash[self.up[y][step]]:
                x, y = self.up[x][step], self.up[y][step]
        if self._same(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)


class Block:
    """Rows added one after the other; the best way from each entry state to each state."""

    def __init__(self, entries: tuple[int, ...] = STATES, prime: int = PRIME):
        self.paths = Paths(prime)
        self.rows = 0
        self.best: dict[int, dict[int, tuple[int, int]]] = {e: self._inserted({e: (0, 0)}) for e in entries}

    def _better(self, new: tuple[int, int], old: tuple[int, int] | None) -> bool:
        return old is None or new[0] < old[0] or (new[0] == old[0] and self.paths.less(new[1], old[1]))

    def _inserted(self, best: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """With insertions before the next row."""
        waiting = sorted(best, key=lambda s: best[s][0])
        while waiting:
            state = waiting.pop(0)
            cost, node = best[state]
            after = NEXT[state]
            known = best.get(after)
            if known is not None and known[0] < cost + INSERT:
                continue
            new = (cost + INSERT, self.paths.add(node, "I"))
            if self._better(new, known):
                best[after] = new
                if after not in waiting:
                    waiting.append(after)
                waiting.sort(key=lambda s: best[s][0])
        return best

    def add(self, initial: str, must_go: bool, cut_off: bool) -> None:
        """One row: its role's initial, whether it must be deleted, whether keeping it costs ``CUT_OFF``."""
        self.rows += 1
        extra = CUT_OFF if cut_off else 0
        for entry, best in self.best.items():
            out: dict[int, tuple[int, int]] = {}

            def offer(state: int, cost: int, node: int, letter: str, out=out) -> None:
                known = out.get(state)
                if known is not None and known[0] < cost:
                    return
                new = (cost, self.paths.add(node, letter))
                if self._better(new, known):
                    out[state] = new

            for state, (cost, node) in best.items():
                offer(state, cost + DELETE, node, "D")
                if must_go:
                    continue
                kept = KEPT.get((state, initial))
                if kept is not None:
                    offer(kept, cost + extra, node, "K")
                else:  # changing a role to what it is costs more than keeping it
                    offer(NEXT[state], cost + REROLE + extra, node, "R")
                    continue
                if kept != NEXT[state]:
                    offer(NEXT[state], cost + REROLE + extra, node, "R")
            self.best[entry] = self._inserted(out)

    def drop(self, count: int) -> None:
        """``count`` more rows that must be deleted."""
        for _ in range(count):
            self.add("", True, False)

    def table(self) -> list[tuple[int, int, int, str]]:
        """(entry, state, cost, edits) of all ways."""
        return [(e, s, cost, self.paths.text(node)) for e, best in self.best.items() for s, (cost, node) in sorted(best.items())]


def chained(tables: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and edits of a whole conversation from the tables of its blocks in order."""
    now: dict[int, tuple[int, str]] = {START: (0, "")}
    for ways in tables:
        after: dict[int, tuple[int, str]] = {}
        for entry, state, cost, edits in ways:
            if entry in now:
                new = (now[entry][0] + cost, now[entry][1] + edits)
                if state not in after or new < after[state]:
                    after[state] = new
        now = after
    return min(now[s] for s in ACCEPTED if s in now)


def applied(edits: str):
    """For each edit: (letter, role): the role written by Rerole and Insert.  To be fed the kept rows' initials."""
    state = START
    initial = yield
    for letter in edits:
        role = None
        if letter in "RI":
            state = NEXT[state]
            role = NAMES[state]
        elif letter == "K":
            state = KEPT[state, initial]
        initial = yield letter, role
