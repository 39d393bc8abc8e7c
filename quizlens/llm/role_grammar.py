"""Weighted repair of a sequence of turns by generalised LR parsing over a grammar of roles.

    S -> empty | P T        P -> s | empty        T -> T u a | u a

An LR automaton of this grammar reads role initials.  At every turn each stack
top may shift it (keep), shift another role in its place (rerole), pass over
it (delete), or shift a role that is not there (insert).  Tops live in a
graph-structured stack: nodes point to what lies below them and are shared.
Equal tops are merged by the least (cost, audit), so at most five are alive.

What a turn does depends only on its kind and on the tops' relative costs and
order, of which few combinations occur; each is worked out once
(:func:`step`) and long conversations run on the remembered steps.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: What a reroled or inserted turn may be.
FREE_ROLES = "ua"
ROLE_NAMES = {"u": "user", "a": "assistant"}
#: A top that costs more than the cheapest one by more than this is on no cheapest way: any top reaches what
#: another one can still read by deleting one kept `s` (3) and inserting at most one role (2), or by inserting a pair (4).
MARGIN = 5

GRAMMAR = (("S", ""), ("S", "PT"), ("P", "s"), ("P", ""), ("T", "Tua"), ("T", "ua"))


def _closure(items: frozenset) -> frozenset:
    items, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        right = GRAMMAR[rule][1]
        for k, (left, _) in enumerate(GRAMMAR):
            if dot < len(right) and right[dot] == left and (k, 0) not in items:
                items.add((k, 0))
                todo.append((k, 0))
    return frozenset(items)


START = _closure(frozenset([(0, 0), (1, 0)]))


@lru_cache(maxsize=None)
def _goto(state: frozenset, symbol: str) -> frozenset | None:
    moved = {(rule, dot + 1) for rule, dot in state if GRAMMAR[rule][1][dot:dot + 1] == symbol}
    return _closure(frozenset(moved)) if moved else None


class Node(NamedTuple):
    """A node of the stack: an LR state and the node below it."""

    state: frozenset
    below: Node | None


def _reductions(top: Node) -> list[Node]:
    """The top itself and all it can be reduced to without reading."""
    out = [top]
    for node in out:
        for rule, dot in node.state:
            left, right = GRAMMAR[rule]
            if dot == len(right) and left != "S":
                base = node
                for _ in right:
                    base = base.below
                state = _goto(base.state, left)
                if state and Node(state, base) not in out:
                    out.append(Node(state, base))
    return out


@lru_cache(maxsize=None)
def _shift(top: Node, role: str) -> Node | None:
    """The top after reading a role, reduced where nothing else can be done."""
    for node in _reductions(top):
        state = _goto(node.state, role)
        if state:
            pushed = Node(state, node)
            return next((n for n in _reductions(pushed) if any(dot < len(GRAMMAR[rule][1]) for rule, dot in n.state)), pushed)
    return None


BOTTOM = Node(START, None)


def _tops() -> list[Node]:
    found = [BOTTOM]
    for node in found:
        for role in "sua":
            after = _shift(node, role)
            if after and after not in found:
                found.append(after)
    return found


#: Every stack that reading can leave, the empty one first.
TOPS = _tops()
ACCEPTING = [any(GRAMMAR[rule][0] == "S" and dot == len(GRAMMAR[rule][1]) for n in _reductions(t) for rule, dot in n.state)
             for t in TOPS]
READ = {(k, role): TOPS.index(after) for k, t in enumerate(TOPS) for role in "sua" if (after := _shift(t, role))}


class Alive(NamedTuple):
    """A live top: cost above the cheapest, place of its audit among the audits at the last turn, inserts since then."""

    cost: int
    rank: int
    inserts: int


Frontier = tuple[Alive | None, ...]


def _inserted(tops: list) -> tuple[list, list]:
    """Tops with all cheapest inserts, and for each the top that its inserts began from and the roles inserted."""
    best = list(tops)
    origin = [(k, "") for k in range(len(TOPS))]
    changed = True
    while changed:
        changed = False
        for k, top in enumerate(best):
            for role in FREE_ROLES:
                to = READ.get((k, role))
                if top is None or to is None:
                    continue
                new = Alive(top.cost + COST[INSERT], top.rank, top.inserts + 1)
                if best[to] is None or _before(new, best[to]):
                    best[to], origin[to], changed = new, (origin[k][0], origin[k][1] + role), True
    return best, origin


def _before(a: Alive, b: Alive) -> bool:
    """By (cost, audit).  Audits of the same cost up to the same turn are no prefixes of each other."""
    return (a.cost, a.rank, a.inserts) < (b.cost, b.rank, b.inserts)


def _normal(tops: list) -> tuple[Frontier, int]:
    """Costs above the least, and that least."""
    least = min(t.cost for t in tops if t)
    return tuple(t and (t._replace(cost=t.cost - least) if t.cost - least <= MARGIN else None) for t in tops), least


@lru_cache(maxsize=None)
def entry(top: int) -> tuple[Frontier, tuple]:
    """The frontier before the first turn, from one top; and the origin of each top."""
    best, origin = _inserted([Alive(0, 0, 0) if k == top else None for k in range(len(TOPS))])
    frontier, _ = _normal(best)
    return frontier, tuple(origin)


@lru_cache(maxsize=100_000)
def step(frontier: Frontier, role: str, must_go: bool, truncated: bool) -> tuple[Frontier, int, tuple]:
    """One turn: the new frontier, what the cheapest top costs more, and for each top where it came from.

    A way back is (top before, the turn's edit and new role, roles inserted after it).
    """
    found: dict[int, tuple] = {}

    def offer(to: int | None, k: int, edit: str, new_role: str, cost: int) -> None:
        if to is None:
            return
        old = frontier[k]
        key = (old.cost + cost, old.rank, INSERT * old.inserts + edit)
        if to not in found or key < found[to][0]:
            found[to] = (key, (k, edit, new_role))

    for k, top in enumerate(frontier):
        if top is None:
            continue
        offer(k, k, DELETE, "", COST[DELETE])
        if not must_go:
            extra = TRUNCATED_COST if truncated else 0
            offer(READ.get((k, role)), k, KEEP, role, COST[KEEP] + extra)
            for new_role in FREE_ROLES:
                offer(READ.get((k, new_role)), k, REROLE, new_role, COST[REROLE] + extra)
    order = sorted({key[1:] for key, _ in found.values()})
    tops = [Alive(found[k][0][0], order.index(found[k][0][1:]), 0) if k in found else None for k in range(len(TOPS))]
    best, origin = _inserted(tops)
    after, least = _normal(best)
    back = tuple((*found[origin[k][0]][1], origin[k][1]) if t else None for k, t in enumerate(after))
    return after, least, back


class Way(NamedTuple):
    """The cheapest way to a top: its cost, audit, and the roles kept, reroled and inserted, `-` where a turn is deleted."""

    cost: int
    audit: str
    roles: str


class Run:
    """Turns read from one entry; only a number a turn is held."""

    def __init__(self, top: int = 0):
        self.top = top
        self.frontier, self.first = entry(top)
        self.cost = 0
        self.backs: list[tuple] = []
        self.times: list[int] = []

    def read(self, role: str, must_go: bool, truncated: bool, times: int = 1) -> None:
        """One turn; ``times`` equal ones only where they must go."""
        self.frontier, more, back = step(self.frontier, role if role in ("s", "u", "a") else "", must_go, truncated)
        # After one deletion the next leaves the same frontier: deletions go before inserts.
        self.cost += more + (times - 1) * COST[DELETE]
        self.backs.append(back)
        self.times.append(times)

    def ways(self) -> dict[int, Way]:
        """The cheapest way to each live top."""
        out = {}
        for top, alive in enumerate(self.frontier):
            if alive is None:
                continue
            audit, roles, at = [], [], top
            for back, times in zip(reversed(self.backs), reversed(self.times)):
                at, edit, role, inserted = back[at]
                audit.append(edit * times + INSERT * len(inserted))
                roles.append((role or "-") * times + inserted)
            begun, inserted = self.first[at]
            assert begun == self.top
            out[top] = Way(self.cost + alive.cost, INSERT * len(inserted) + "".join(reversed(audit)),
                           inserted + "".join(reversed(roles)))
        return out


def joined(before: dict[int, Way], segments: list[dict[int, Way]]) -> dict[int, Way]:
    """Ways through a segment, after the ways to where it begins; ``segments`` holds its ways by entry."""
    out: dict[int, Way] = {}
    for top, way in before.items():
        for end, more in segments[top].items():
            new = Way(way.cost + more.cost, way.audit + more.audit, way.roles + more.roles)
            if end not in out or new[:2] < out[end][:2]:
                out[end] = new
    return out


def accepted(ways: dict[int, Way]) -> Way:
    """The cheapest way that ends in a whole conversation; of ways that cost the same, the least audit."""
    return min((w for k, w in ways.items() if ACCEPTING[k]), key=lambda w: w[:2])
