"""Cheapest edits of a run of conversation rows, by a persistent audit DP.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. Before a row, and
after the last one, user or assistant turns may be inserted (I, 5 each); a row is kept (K, 0),
given another role (R, 1) or deleted (D, 2; required for blank and duplicate rows), and a
truncated row that stays adds 5. Four states tell what has been written: nothing, s, u or a.
The audit so far decides the state, so it also decides every role that is written.

Every state holds its cheapest cost and the ASCII-least audit of that cost. Audits are nodes
of one tree: a letter and a link to the edits before, so states share what they have in
common. A node has the hash of its whole path and links to its ancestors 1, 2, 4, ... back.
Two audits are compared where they part, which is found by jumps over equal hashes; that the
part before is really equal is confirmed letter by letter, back to a node that both share or
to a pair confirmed before.

Two audits of equal cost over the same rows are never each other's beginning, since the longer
one would only add insertions. So the least of the audits so far stays least whatever follows.
"""

from __future__ import annotations

from collections.abc import Sequence

NOTHING, S, U, A = range(4)
FAR = 1 << 60
INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5
#: State reached by writing user or assistant.
WRITTEN = (U, U, A, U)
END = (0, FAR, FAR, 0)
#: What a row is: as it should be, truncated, or to be deleted.
WHOLE, TRUNCATED, GONE = range(3)
_PRIME, _BASE = (1 << 61) - 1, 911_382_323


class Audits:
    """A tree of edits; node 0 is the empty audit."""

    def __init__(self, prime: int = _PRIME) -> None:
        self.prime = prime
        self.letter, self.depth, self.hash, self.back = [""], [0], [0], [[]]
        self.confirmed: set[tuple[int, int]] = set()

    def add(self, node: int, letters: str) -> int:
        for letter in letters:
            links = [node]
            while len(self.back[links[-1]]) >= len(links):
                links.append(self.back[links[-1]][len(links) - 1])
            self.letter.append(letter)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * _BASE + ord(letter)) % self.prime)
            self.back.append(links)
            node = len(self.letter) - 1
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.back[node][0]
        return "".join(reversed(out))

    def _lifted(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.back[node][k]
            steps >>= 1
            k += 1
        return node

    def _alike(self, a: int, b: int) -> bool:
        """Whether two paths of one length and hash have the same letters."""
        walked = []
        while a != b and (a, b) not in self.confirmed:
            if self.letter[a] != self.letter[b]:
                return False
            walked.append((a, b))
            a, b = self.back[a][0], self.back[b][0]
        self.confirmed.update(walked)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the audit of ``a`` comes before that of ``b``."""
        if a == b:
            return False
        size = min(self.depth[a], self.depth[b])
        x, y = self._lifted(a, self.depth[a] - size), self._lifted(b, self.depth[b] - size)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b] if self._alike(x, y) else self.text(a) < self.text(b)
        for k in reversed(range(len(self.back[x]))):
            if k < len(self.back[x]):
                u, v = self.back[x][k], self.back[y][k]
                if self.hash[u] != self.hash[v]:
                    x, y = u, v
        if self._alike(self.back[x][0], self.back[y][0]):
            return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)


def _moves(state: int, initial: str, kind: int) -> list[tuple[int, int, str]]:
    """(state, cost, letter) of what may be done with a row."""
    moves = [(state, DELETE, "D")]
    if kind != GONE:
        extra, written = CUT if kind == TRUNCATED else 0, WRITTEN[state]
        moves.append((written, REROLE + extra, "R"))
        if initial == "sua"[written - 1]:
            moves.append((written, extra, "K"))
        elif initial == "s" and state == NOTHING:
            moves.append((S, extra, "K"))
    return moves


#: The same for every state, initial and kind, made once.
MOVES = {(i, kind): [_moves(state, i, kind) for state in range(4)] for i in ("s", "u", "a", "") for kind in (WHOLE, TRUNCATED, GONE)}


def _moves_of(initial: str, kind: int) -> list[list[tuple[int, int, str]]]:
    return MOVES[(initial if initial in ("s", "u", "a") else "", kind)]


def _inserted(cost: list[int]) -> list[int]:
    """Cheapest costs with insertions after them; two in a row are the most that can help."""
    out = list(cost)
    out[U] = min(cost[U], min(cost[NOTHING], cost[S], cost[A]) + INSERT)
    out[A] = min(cost[A], out[U] + INSERT)
    return out


def costs(rows: Sequence[tuple[str, int]], last: bool) -> list[list[int]]:
    """Cheapest cost from each state before the rows to each state after them; insertions at the end only if ``last``."""
    out = []
    for entry in range(4):
        cost = [FAR] * 4
        cost[entry] = 0
        for initial, kind in rows:
            cost, before = [FAR] * 4, _inserted(cost)
            for state, moves in enumerate(_moves_of(initial, kind)):
                if before[state] < FAR:
                    for to, price, _ in moves:
                        cost[to] = min(cost[to], before[state] + price)
        out.append(_inserted(cost) if last else cost)
    return out


def cheapest(rows: Sequence[tuple[str, int]], entry: int = NOTHING, after: Sequence[int] = END, last: bool = True, prime: int = _PRIME) -> tuple[int, str, int]:
    """Cost, audit and state after the rows, for the least of cost plus ``after`` of that state, then of the audit."""
    tree = Audits(prime)
    cost, node = [FAR] * 4, [0] * 4
    cost[entry] = 0

    def offer(cost: list[int], node: list[int], to: int, price: int, origin: int, letters: str) -> None:
        if price < cost[to]:
            cost[to], node[to] = price, tree.add(origin, letters)
        elif price == cost[to] and price < FAR:
            other = tree.add(origin, letters)
            if tree.less(other, node[to]):
                node[to] = other

    def inserted() -> tuple[list[int], list[int]]:
        more, nodes = list(cost), list(node)
        for state in (NOTHING, S, A):
            if cost[state] < FAR:
                offer(more, nodes, U, cost[state] + INSERT, node[state], "I")
        if more[U] < FAR:
            offer(more, nodes, A, more[U] + INSERT, nodes[U], "I")
        return more, nodes

    for initial, kind in rows:
        before, nodes = inserted()
        cost, node = [FAR] * 4, [0] * 4
        for state, moves in enumerate(_moves_of(initial, kind)):
            if before[state] < FAR:
                for to, price, letter in moves:
                    offer(cost, node, to, before[state] + price, nodes[state], letter)
    if last:
        cost, node = inserted()
    best = FAR, -1
    for state in range(4):
        total = cost[state] + after[state]
        if total < best[0] or (total == best[0] < FAR and tree.less(node[state], node[best[1]])):
            best = total, state
    state = best[1]
    return (cost[state], tree.text(node[state]), state) if state >= 0 else (FAR, "", -1)
