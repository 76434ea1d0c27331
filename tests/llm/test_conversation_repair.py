"""Conversation repair: audits against all edits, long conversations against whole ones, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"


def all_repairs(faults, initials):
    """Every sequence of edits with up to two inserted rows at a place; yields (cost, audit) of those that end well."""

    def go(i, roles, cost, audit, inserted):
        if i == len(faults) and re.fullmatch("(s?(ua)+)?", roles):
            yield cost, audit
        if inserted < 2:
            for role in "ua":
                yield from go(i, roles + role, cost + 2, audit + "I", inserted + 1)
        if i < len(faults):
            yield from go(i + 1, roles, cost + 3, audit + "D", 0)
            if faults[i] in (C.SOUND, C.CUT):
                more = int(faults[i] == C.CUT)
                if initials[i]:
                    yield from go(i + 1, roles + initials[i], cost + more, audit + "K", 0)
                for role in "ua":
                    yield from go(i + 1, roles + role, cost + 2 + more, audit + "R", 0)

    return go(0, "", 0, "", 0)


def test_the_audit_is_the_least_of_all_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(0, 4)
        faults, initials = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)], [rng.choice(["s", "u", "a", "t", ""]) for _ in range(n)]
        assert C.best_audit(faults, initials) == min(all_repairs(faults, initials)), (faults, initials)


def test_tables_multiply_to_the_same_way():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randint(1, 40)
        faults, initials = [rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n)], [rng.choice(["s", "u", "a"]) for _ in range(n)]
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(3))})
        whole = C.products([C.chunk_table(faults[a:b], initials[a:b]) for a, b in itertools.pairwise(cuts)])
        assert min(whole[0, t] for t in (0, 3) if (0, t) in whole) == C.best_audit(faults, initials)


ODD = [
    (1, 0, "user", "Hello there."), (1, 1, "assistant", "Yes?"), (1, 1, "assistant", "Yes?"), (1, 2, "user", " \t"), (1, 9, "user", "no end"),
    (2, None, None, None), (2, None, "user", "x."), (None, 3, "user", "Hi."), (None, 3, "assistant", ""), (None, None, "system", "Be good."),
    (3, -5, "", "odd role."), (3, -9223372036854775808, "user", "é" * 3000 + "!"), (3, 9223372036854775807, "assistant", "end."), (4, 1, "tool", "a."),
]


def plain(rows):
    """The contract, row by row, on the damaged rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        damaged = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in damaged:
            ink = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append(1 if not ink else 2 if (role, text) in seen else 0 if ink[-1] in ".!?" else 3)
            seen.add((role, text))
        initials = [r[1][:1] for r in damaged]
        turns = [r[0] for r in damaged if r[0] is not None]
        gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), (1 << 63) - 1) if turns else 0
        cost, audit = C.best_audit(faults, initials)
        lines, state, at = [], "", iter(damaged)
        for edit in audit:
            role = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append(f"{role}:")
                state = role[0]
                continue
            _, old, text = next(at)
            if edit != "D":
                role = old if edit == "K" else role
                lines.append(f"{role}:{text}")
                state = role[0]
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("most_rows", [C.ROWS, 2])
def test_odd_rows(spark, most_rows):
    got = C.repair_conversations(C.damage(spark.createDataFrame(ODD, SCHEMA).withColumn("gone", F.lit(7))), most_rows=most_rows, chunk=2).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(ODD) and len(got) == 5


def test_long_conversations_are_cut_into_ranges(spark):
    rng = random.Random(11)
    rows = [(rng.choice([7, 7, 7, 8, 9]), rng.randint(0, 150), rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["One.", "Two", " ", "Three!", f"{rng.random()}."])) for _ in range(600)]
    rows += [(7, 20, "user", "again and again.")] * 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_conversations(C.damage(df), most_rows=10, chunk=7).collect()}
    assert got == plain(rows)


def test_no_conversations_and_dropped_ones(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair_conversations(C.damage(none)).count() == 0
    dropped = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = spark.createDataFrame([(5, dropped, "user", "x.")], SCHEMA)
    empty = (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert [tuple(r) for r in C.repair_conversations(C.damage(rows)).collect()] == [empty]
    assert [tuple(r) for r in C.repair_conversations(C.damage(rows), most_rows=0).collect()] == [empty]


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Yes."), (1, 1, "assistant", "No.")], SCHEMA).withColumn("gone", F.lit(False))
    assert [tuple(r)[2:] for r in C.repaired_turns(rows).orderBy("place").collect()] == [("user", "Yes."), ("assistant", "No.")]
