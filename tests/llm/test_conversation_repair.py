"""Conversation repair: cheapest edits against a search over all of them, coalescence, edge cases, the query against plain code."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from cloudweft.llm import conversation_repair as repair
from cloudweft.llm import queries

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """(cost, edits) of (role, fault) rows by best-first search over (cost, edits)."""
    done, heap = {}, [(0, "", 0, 0)]
    while heap:
        cost, said, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done[i, q] = (cost, said)
        to = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 3, said + "I", i, to))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 4, said + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in NEXT[q]:
                    heapq.heappush(heap, (cost + more, said + "K", i + 1, NEXT[q][role[:1]]))
                heapq.heappush(heap, (cost + 3 + more, said + "R", i + 1, to))
    return min(done[len(rows), q] for q in (0, 3) if (len(rows), q) in done)


def all_edits(rows):
    """The same by writing out all edits with at most two insertions in a row."""
    found = []

    def go(i, q, cost, said, ins):
        to = 3 if q == 2 else 2
        if i == len(rows) and q in (0, 3):
            found.append((cost, said))
        if ins < 2:
            go(i, to, cost + 3, said + "I", ins + 1)
        if i < len(rows):
            role, fault = rows[i]
            go(i + 1, q, cost + 4, said + "D", 0)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in NEXT[q]:
                    go(i + 1, NEXT[q][role[:1]], cost + more, said + "K", 0)
                go(i + 1, to, cost + 3 + more, said + "R", 0)

    go(0, 0, 0, "", 0)
    return min(found)


def walked(rows):
    r = repair.Repair()
    code = {"blank": repair.FORCED, "duplicate": repair.FORCED, "truncated": repair.CUT, None: repair.KEEPS}
    out = [e for role, fault in rows for e in r.turn(role, "x", code[fault])] + list(r.end())
    return r, out


ROLES = ["system", "user", "assistant", "tool", " ", ""]
FAULTS = [None, "blank", "duplicate", "truncated"]


@pytest.mark.parametrize("weights", [(1, 5, 5, 1, 0.2, 0.2), (1, 1, 1, 1, 1, 1), (0, 1, 0, 0, 0, 0), (0, 1, 0.1, 0, 0, 0), (3, 1, 1, 0, 0, 0), (0, 0, 1, 0, 0, 0)])
def test_cheapest_edits_and_ties(weights):
    rng = random.Random(repr(weights))
    for k in range(250):
        odds = rng.choice([(8, 1, 1, 1), (1, 1, 1, 1), (1, 5, 1, 1), (1, 0, 0, 0), (1, 0, 0, 5)])
        rows = [(rng.choices(ROLES, weights)[0], rng.choices(FAULTS, odds)[0]) for _ in range(rng.randint(0, 5 if k < 60 else 40))]
        r, out = walked(rows)
        assert (r.cost, "".join(x for x, _ in out)) == cheapest(rows), rows
        if k < 60:
            assert all_edits(rows) == cheapest(rows)
        roles = "".join(turn[0][0] for _, turn in out if turn)
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_edits_come_early_and_the_tree_stays_small():
    rng = random.Random(5)
    r = repair.Repair()
    rows = [(rng.choice(ROLES[:4]), rng.choice([repair.KEEPS] * 4 + [repair.FORCED, repair.CUT])) for _ in range(20_000)]
    early = sum(len(list(r.turn(role, "x", f))) for role, f in rows)
    left = len(list(r.end()))
    assert left < 60 and r.longest < 60 and early + left >= len(rows)


def test_a_tie_that_stays_open_is_still_exact():
    rows = [("user", None)] * 1501
    r, out = walked(rows)
    assert (r.cost, "".join(x for x, _ in out)) == cheapest(rows) and r.longest >= 1500


def damaged_rows(rows):
    """{conv_id: turns after damage in order} of (conv_id, turn, role, text), in plain code."""
    out: dict = {}
    rows = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    for conv, turn, role, text in sorted(rows, key=lambda x: (repr(x[0]), x[1] is not None, x[1] or 0, *x[2:])):
        have = out.setdefault(conv, [])
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        have += [(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def audit(turns):
    faults, seen = [], set()
    for _, role, text in turns:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
        seen.add((role, text))
    at = [t for t, _, _ in turns if t is not None]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, said = cheapest([(role, f) for (_, role, _), f in zip(turns, faults)])
    kept, k, q = [], 0, ""
    for e in said:
        wanted = "assistant" if q == "u" else "user"
        if e == "I":
            kept.append((wanted, ""))
        else:
            _, role, text = turns[k]
            k += 1
            if e != "D":
                kept.append((wanted if e == "R" else role, text))
        q = kept[-1][0][0] if kept else ""
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, said, digest


def compare(spark, df, rows):
    found = {r[0]: tuple(r[1:]) for r in df.collect()}
    want = {c: audit(t) for c, t in damaged_rows(rows).items()}
    assert found == want


def test_the_query(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op13_conversation_repair(spark, tiny)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    compare(spark, df, rows)


def test_nulls_ties_repeats_long_and_empty(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, 0, 1, 2, 5, 9, -3]), rng.choice([None, *ROLES]), rng.choice([None, "", " \t", "Yes.", "No", "é 😀!", "a.\x0b", "x" * 200_000 + "."])) for _ in range(300)]
    rows += rows[:40] + [(7, 0, "user", "y.")] * 30 + [(8, k, "user", "Same.") for k in range(300)]
    turns = spark.createDataFrame([(*r, "z", 3) for r in rows], "conv_id long, turn long, role string, text string, place string, dropped int")
    compare(spark, repair.audits(repair.damaged(turns)), rows)
    assert repair.audits(repair.damaged(turns.limit(0))).count() == 0


def test_a_conversation_that_lost_all_turns(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = spark.createDataFrame([(conv, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert tuple(repair.audits(repair.damaged(turns)).first()) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_rebuild_the_repaired_conversation(spark, tiny):
    turns = repair.damaged(spark.read.parquet(f"{tiny}/conversations.parquet"))
    told = {r.conv_id: (r.audit, r.repaired_sha256) for r in repair.audits(turns).collect()}
    said: dict = {c: [] for c in told}
    for r in sorted(repair.edits(turns).collect(), key=lambda r: (r.conv_id, r.step)):
        said[r.conv_id].append(r)
    for c, (letters, sha) in told.items():
        assert "".join(r.edit for r in said[c]) == letters
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in said[c] if r.edit != "D").encode()).hexdigest() == sha


def test_one_shuffle(spark, tiny):
    plan = queries.op13_conversation_repair(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial")[0].count("Exchange") == 1
