"""Conversation repair against a plain search over all edits: a conversation over many partitions, nulls, odd roles, repeated rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from webloom.llm import repair

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
NAME = {2: "user", 3: "assistant"}


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:200], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {0: (0, "", ())}

        def insert(best):
            for _ in range(2):
                for s, (c, a, lines) in list(best.items()):
                    t = NEXT[s]
                    best[t] = min(best.get(t, (10**9,)), (c + 3, a + "I", (*lines, NAME[t] + ":")))

        for (_, role, text), fault in zip(own, faults):
            insert(best)
            new = {}
            for s, (c, a, lines) in best.items():
                ways = [(s, c + 4, "D", lines)]
                if fault not in ("blank", "duplicate"):
                    fee, t = 3 * (fault == "truncated"), NEXT[s]
                    ways.append((t, c + 3 + fee, "R", (*lines, f"{NAME[t]}:{text}")))
                    if (role[:1], s) in KEEP:
                        ways.append((KEEP[role[:1], s], c + fee, "K", (*lines, f"{role}:{text}")))
                for t, cost, letter, said in ways:
                    new[t] = min(new.get(t, (10**9,)), (cost, a + letter, said))
            best = new
        insert(best)
        cost, audit, lines = min(best[s] for s in (0, 3) if s in best)
        turns = {r[0] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in own]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rnd = random.Random(8)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    text = lambda: rnd.choice(["Yes.", "No!", "Why?", "cut off", "é", "", " \n", None, f"Line {rnd.random()}.\n", f"{rnd.random()} and"])
    rows = []
    for conv in range(60):
        for turn in range(rnd.randint(1, 9)):
            if rnd.random() < 0.9:
                rows.append((conv, None if rnd.random() < 0.05 else turn, rnd.choice(roles[: rnd.choice([2, 3, 8])]), text()))
    rows += [(100, t, "user", f"Only users {t}.") for t in range(200)]  # an insertion or a change of role in between
    rows += [(101, t, rnd.choice(roles[:5]), text() if rnd.random() < 0.2 else f"Say {t}.") for t in range(700)]  # over all partitions
    rows += [(101, 3, "user", "Again and again.")] * 300  # equal rows
    rows += [(None, t, rnd.choice(roles[:2]), f"Null {t}.") for t in range(5)] + [(102, None, "user", "x" * 300), (102, None, "user", "x" * 300 + "."), (103, 2, None, None)]
    rnd.shuffle(rows)
    return rows


def test_repair(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, n int").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, repair.repair_conversations(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == brute(rows)


def test_layers():
    """The first layer with the start state is the least cost, for every sequence of up to four rows."""
    import itertools

    for n in range(5):
        for roles in itertools.product(["user", "assistant", "system", "tool"], repeat=n):
            run = repair._Run()
            rows = [(0, k, role, f"{k}.") for k, role in enumerate(roles)]
            for _, _, role, text in rows:
                run.add(role, text, 1, True, False)
            state, paid, audit, lines = repair._trace(run, repair._solved([run], [repair._ACCEPT])[0], 0)
            more, inserted = repair._end(state)
            want = brute(rows)[0] if rows else (0,) * 6 + (0, "", hashlib.sha256(b"").hexdigest())
            assert (paid + 3 * len(more), audit + more, repair._sha(lines + inserted)) == want[6:]


@pytest.mark.parametrize("segment", [1, 5, 64])
def test_segments(monkeypatch, segment):
    """However a conversation is cut into segments and runs, the audit is the same."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rnd = random.Random(segment)
    for _ in range(30):
        rows = [(0, k, rnd.choice(["user", "assistant", "system", "tool"]), f"{k}" + rnd.choice([".", ""])) for k in range(rnd.randint(0, 40))]
        cut = rnd.randint(0, len(rows))
        runs = [repair._Run(), repair._Run()]
        for k, (_, _, role, text) in enumerate(rows):
            runs[k >= cut].add(role, text, 1, True, not text.endswith("."))
        beyond = repair._times(runs[1].matrix(), repair._ACCEPT)
        state, paid, audit, lines = repair._trace(runs[0], repair._solved(runs[:1], [beyond])[0], 0)
        end, more, rest, after = repair._trace(runs[1], repair._solved(runs[1:], [np.array(repair._ACCEPT)])[0], state)
        tail, inserted = repair._end(end)
        cost = sum(r.base for r in runs) + paid + more + 3 * len(tail)
        want = brute(rows)[0][6:] if rows else (0, "", hashlib.sha256(b"").hexdigest())
        assert (cost, audit + rest + tail, repair._sha(lines + after + inserted)) == want


def test_damage_and_nothing(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(None, None, None, None), (7, None, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import zlib

    want = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        want += [(c, t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    assert sorted(map(tuple, repair.damage(df).collect()), key=str) == sorted(want, key=str)
    assert repair.repair_conversations(df.limit(0)).count() == 0
