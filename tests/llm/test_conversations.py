"""Repair against every sequence of edits, for short conversations, and against a plain search for longer ones."""

import hashlib
import itertools
import re
import zlib

import pytest

from quillmere.llm import conversations as conv

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def judged(rows):
    """Rows in order with their faults, from (turn, role, text)."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
    out, seen = [], set()
    for t, r, x in rows:
        core = x.strip(" \t\n\v\f\r")
        fault = "blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((r, x))
        out.append((t, r, x, fault))
    return out


def edits(row):
    """(cost, letter, line) of what may become of a row."""
    _, r, x, fault = row
    late = fault == "truncated"
    out = [(3, "D", None)]
    if fault not in ("blank", "duplicate"):
        out += [(late, "K", (r, x))] + [(2 + late, "R", (new, x)) for new in ("user", "assistant")]
    return out


def tried(rows):
    """The best of all sequences of edits with at most two inserts at a place."""
    gaps = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for chosen in itertools.product(*map(edits, rows)):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            steps = [(2, "I", (g, "")) for g in put[0]]
            for c, p in zip(chosen, put[1:]):
                steps += [c] + [(2, "I", (g, "")) for g in p]
            state = 0
            for _, _, line in steps:
                state = state if line is None else NEXT.get((state, line[0][:1]), 9)
            if state in (0, 3):
                found = (sum(s[0] for s in steps), "".join(s[1] for s in steps), [s[2] for s in steps if s[2]])
                best = min(best or found, found)
    return best


def searched(rows):
    """The same by lists of the best way to each state, with inserts tried one at a time until nothing changes."""

    def closed(ways):
        while True:
            new = dict(ways)
            for s, (c, p, t) in ways.items():
                for g in ("user", "assistant"):
                    if (s, g[0]) in NEXT:
                        to, way = NEXT[s, g[0]], (c + 2, p + "I", [*t, (g, "")])
                        new[to] = min(new.get(to, way), way)
            if new == ways:
                return ways
            ways = new

    ways = closed({0: (0, "", [])})
    for row in rows:
        new = {}
        for s, (c, p, t) in ways.items():
            for cost, letter, line in edits(row):
                to = s if line is None else NEXT.get((s, line[0][:1]))
                if to is not None:
                    way = (c + cost, p + letter, t if line is None else [*t, line])
                    new[to] = min(new.get(to, way), way)
        ways = closed(new)
    return min(ways[s] for s in (0, 3) if s in ways)


def expected(rows, best):
    rows = judged(rows)
    cost, audit, lines = best(rows)
    known = [t for t, *_ in rows if t is not None]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        **{f: sum(r[3] == f for r in rows) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest(),
    }


def checked(spark, chats, best, more=()):
    rows = [(k, *r, 5, "x") for k, chat in chats.items() for r in chat]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at int, pieces string")
    ids = spark.createDataFrame([(k,) for k in [*chats, *more]], "conv_id long")
    repair = conv.repair_conversations(df, ids)
    got = repair.report.join(conv.repaired_digests(repair.slices), "head", "left").collect()
    assert len(got) == len({*chats, *more})
    for row in got:
        row = row.asDict()
        row["repaired_sha256"] = row["repaired_sha256"] or hashlib.sha256(b"").hexdigest()
        assert row.pop("head") is not None or row["conv_id"] in more
        want = expected(chats.get(row["conv_id"], []), best)
        assert {k: row[k] for k in want} == want, (row["conv_id"], chats.get(row["conv_id"]))
    return repair


def drawn(rng, n):
    texts = ["Good.", "So?", "cut off", "", " \n", "é!", None, "x." * 300]
    return [(rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", "", None, "usher"]), rng.choice(texts)) for _ in range(n)]


def test_against_all_edits(spark):
    import random

    rng = random.Random(1)
    chats = {k: drawn(rng, k % 3) for k in range(90)}
    checked(spark, {k: c for k, c in chats.items() if c}, tried, [k for k, c in chats.items() if not c])
    for rows in chats.values():
        rows = judged(rows)
        assert tried(rows) == searched(rows)


@pytest.mark.parametrize("size", [1, 2, 5, 512])
def test_slices_and_ranges(spark, monkeypatch, size):
    """Conversations that lie in one slice or in many, and in several ranges; null ids and repeated rows."""
    import random

    rng = random.Random(size)
    monkeypatch.setattr(conv, "SLICE", size)
    chats = {k: drawn(rng, rng.randrange(1, 9)) for k in range(30)} | {None: drawn(rng, 6), 77: drawn(rng, 120), 78: [(0, "user", "Same.")] * 40, 79: [(i, "ua"[i % 2] + "x", "Fine.") for i in range(30)]}
    repair = checked(spark, chats, searched, [1000, 1001])
    lines = {}
    for t in sorted(repair.turns().collect(), key=lambda t: (t.slice, t.place)):
        lines.setdefault(t.conv_id, []).append((t.role, t.text))
    for k, chat in chats.items():
        assert lines.get(k, []) == searched(judged(chat))[2]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conv.repair_conversations(df).report.count() == 0
    assert conv.repair_conversations(df, df).report.count() == 0


def test_damage(spark):
    rows = [(k, t, "assistant", "One. Two! Three?") for k in range(40) for t in range(3)] + [(None, None, None, None), (7, None, "user", None)]
    got = {}
    for r in conv.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for k, t, role, text in rows:
        h = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if h == 0:
            assert (k, t) not in got
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        assert got[k, t] == [("user" if h == 4 else role, text)] * (2 if h == 3 else 1)
