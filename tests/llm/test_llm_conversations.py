"""Conversation repair against plain statements of the same rules."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

import odd_rows
from conftest import SF_SMALL
from quizlens.llm import conversation_repair, role_grammar
from quizlens.llm.role_grammar import COST, Run, accepted, joined

NAMES = {"u": "user", "a": "assistant"}
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def every_way(rows, inserts):
    """All edits of a few turns with at most so many inserts, as (cost, audit, roles) of those that end in legal roles."""
    def ways(k, left, cost, audit, roles):
        if k == len(rows) and LEGAL.match(roles):
            yield cost, audit, roles
        if left:
            for new in "ua":
                yield from ways(k, left - 1, cost + 2, audit + "I", roles + new)
        if k < len(rows):
            role, must_go, truncated = rows[k]
            yield from ways(k + 1, left, cost + 3, audit + "D", roles)
            if not must_go:
                yield from ways(k + 1, left, cost + truncated, audit + "K", roles + role)
                for new in "ua":
                    yield from ways(k + 1, left, cost + 2 + truncated, audit + "R", roles + new)

    return ways(0, inserts, 0, "", "")


def run_of(rows, top=0):
    run = Run(top)
    for row in rows:
        run.read(*row)
    return run


def some_rows(r, n):
    return [(r.choice(["s", "u", "a", "x"]), r.random() < 0.2, r.random() < 0.3) for _ in range(n)]


def test_cheapest_edits_by_trying_all():
    r = random.Random(2)
    for _ in range(120):
        rows = some_rows(r, r.randint(0, 4))
        cost, audit, roles = min(every_way(rows, 3))
        way = accepted(run_of(rows).ways())
        assert (way.cost, way.audit, way.roles.replace("-", "")) == (cost, audit, roles)


def test_segments_join_to_the_whole():
    r = random.Random(3)
    for _ in range(500):
        rows = some_rows(r, r.randint(0, 12))
        a, b = sorted((r.randint(0, len(rows)), r.randint(0, len(rows))))
        ways = run_of(rows[:a]).ways()
        for part in (rows[a:b], rows[b:]):
            ways = joined(ways, [run_of(part, top).ways() for top in range(len(role_grammar.TOPS))])
        assert accepted(ways) == accepted(run_of(rows).ways())


def test_equal_turns_are_deleted_at_once():
    run, one = Run(), Run()
    for r in (run, one):
        r.read("u", False, False)
    run.read("u", True, False, 5)
    for _ in range(5):
        one.read("u", True, False)
    assert accepted(run.ways()) == accepted(one.ways()) == (17, "KDDDDDI", "u-----a")


def test_few_tops_live():
    assert len(role_grammar.TOPS) == 5
    run = run_of(some_rows(random.Random(4), 5000))
    assert sum(t is not None for t in run.frontier) <= 5 and max(t.cost for t in run.frontier if t) <= role_grammar.MARGIN


def inserted(best):
    """Cheapest (cost, audit, turns) by state of the automaton of ``s?(ua)*``, after any inserts."""
    best, changed = dict(best), True
    while changed:
        changed = False
        for state, (cost, audit, turns) in list(best.items()):
            for role in "ua":
                to = STATES[state].get(role)
                new = (cost + COST["I"], audit + "I", [*turns, (NAMES[role], "")])
                if to is not None and (to not in best or new[:2] < best[to][:2]):
                    best[to], changed = new, True
    return best


STATES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def repair(rows):
    """One conversation's result from its (turn, role, text), by whole audits as strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, best, faults = set(), inserted({0: (0, "", [])}), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        left = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        found = {}

        def offer(to, new):
            if to is not None and (to not in found or new[:2] < found[to][:2]):
                found[to] = new

        for state, (cost, audit, turns) in best.items():
            offer(state, (cost + 3, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                offer(STATES[state].get(role[:1]), (cost + extra, audit + "K", [*turns, (role, text)]))
                for r in "ua":
                    offer(STATES[state].get(r), (cost + 2 + extra, audit + "R", [*turns, (NAMES[r], text)]))
        best = inserted(found)
    cost, audit, turns = min((v for k, v in best.items() if k in (0, 3)), key=lambda v: v[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    known = {r[0] for r in rows if r[0] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return gaps, *faults.values(), illegal, cost, audit, digest


def damage(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        how = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        convs[conv] += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return convs


@pytest.mark.parametrize("table", ["odd", "given"])
def test_query_by_brute_force(spark, table):
    turns = (spark.createDataFrame(odd_rows.conversation_rows(), odd_rows.CONVERSATIONS) if table == "odd"
             else spark.read.parquet(f"{SF_SMALL}/conversations.parquet"))
    want = {conv: repair(rows) for conv, rows in damage(tuple(r) for r in turns.collect()).items()}
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repaired(conversation_repair.damaged(turns), turns).collect()}
    assert got == want


def test_a_conversation_over_many_tasks(spark):
    """One conversation with nearly all rows, some of them alike and some without a turn."""
    r = random.Random(6)
    rows = [(1, None if k % 50 == 0 else k // 3, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "no", "Why?", f"{k}."]))
            for k in range(3000)] + [(2, 0, "user", "Alone.")]
    turns = spark.createDataFrame(rows, odd_rows.CONVERSATIONS).repartition(8)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repaired(turns).collect()}
    assert got == {c: repair([x[1:] for x in rows if x[0] == c]) for c in (1, 2)}


def test_no_turns_after_damage(spark):
    ids = spark.createDataFrame([(1,), (None,)], "conv_id long")
    none = spark.createDataFrame([], odd_rows.CONVERSATIONS)
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, conversation_repair.repaired(none, ids).collect()), key=repr) == [
        (1, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]
