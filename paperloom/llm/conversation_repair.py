"""Structure repair of conversations: the cheapest edits that give turns of ``(s?(ua)+)?``, by A* on the edit lattice.

A node of the lattice is (rows consumed, state); states are *start*, after a system, a user and an assistant row. Edges: Keep (0; the row's role fits), Rerole
(2; to the role that fits), Delete (3), Insert an empty row of the role that fits (2). A row that is blank or repeats an earlier one must be deleted; a truncated one adds 1 unless it is deleted.
The heuristic is the suffix sum of what no path avoids: 3 for each row that must go, 1 for each truncated one. It is consistent, so the first node popped by
(cost plus heuristic, audit) at a place is the cheapest way there, and of the cheapest the one whose audit is least in ASCII order. An audit fixes the repaired rows: each edit leaves one choice of role.

Conversations of up to ``ROWS`` rows and ``BYTES`` are searched whole in a worker, from rows sorted by conversation (one exchange, bounded memory). A longer one is never held in a task: its equal rows are folded to one with a
number, its sorted rows are cut into ranges, each task searches chunks of ``CHUNK`` rows from every state to every state, and the 4 x 4 tables of (cost, audit) are multiplied in a tree, as min-plus matrices.
Then its rows stream once more past the audit, for the digest. SHA-256 is sequential: a conversation's digest is one stream, which holds a batch of rows at a time, and a conversation is as long as its audit fits into a string.

Order: by turn, nulls first, then role and text (ties are settled by content, equal rows in any order). Null role or text: one space. Null conv_id: a conversation of its own. A row with an empty role has no initial: it is kept nowhere.
Repeated rows: duplicates. Gaps beyond a long: the greatest long. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a conversation that is searched whole may have at most, and the rows of a chunk of a longer one.
ROWS, BYTES, CHUNK = 2000, 32 << 20, 500
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = ("su", "ua", "au")
LONGEST = (1 << 63) - 1
INK = re.compile(r"[^\x20\x09-\x0D]")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: The fault of a row, and the least that it costs.
SOUND, BLANK, DUPLICATE, CUT = range(4)
LEAST = (0, DELETE, DELETE, TRUNCATED)

SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """The damage of the contract: (conv_id, turn, role, text, gone), a row for each row, two for one that is repeated.

    By crc32 of ``conv_id:turn`` modulo 20: 0 marks the row as gone, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    space = F.lit(" ")
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("_kind"))
    changed = rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") == 0).alias("gone"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return changed.drop("_copy")


def fault(text: str, seen: bool) -> int:
    if not INK.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND if text.rstrip(SPACE)[-1] in ".!?" else CUT


def following(state: int) -> int:
    """The state after a row of the one role that an inserted or reroled row can have."""
    return ASSISTANT if state == USER else USER


def kept_state(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    return following(state) if initial == ("a" if state == USER else "u") else None


def search(faults: list[int], initials: list[str], start: int, goals: set[int], every: bool = True) -> dict[int, tuple[int, str]]:
    """The (cost, audit) of the best way from a state before the rows to each of the goals' states after them, or to the first that is reached."""
    n = len(faults)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + LEAST[faults[i]]
    heap = [(rest[0], "", 0, start)]
    done, found = set(), {}
    while heap and len(found) < len(goals):
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in goals:
            found[state] = (f, audit)
            if not every:
                break
        ahead = following(state)
        heapq.heappush(heap, (f + INSERT, audit + "I", i, ahead))
        if i < n:
            spared = LEAST[faults[i]]
            heapq.heappush(heap, (f + DELETE - spared, audit + "D", i + 1, state))
            if faults[i] in (SOUND, CUT):
                if (to := kept_state(state, initials[i])) is not None:
                    heapq.heappush(heap, (f + KEEP, audit + "K", i + 1, to))
                heapq.heappush(heap, (f + REROLE, audit + "R", i + 1, ahead))
    return found


def best_audit(faults: list[int], initials: list[str]) -> tuple[int, str]:
    """The (cost, audit) of a whole conversation: it ends where it began, without rows, or after an assistant."""
    return min(search(faults, initials, START, {START, ASSISTANT}, every=False).values())


#: (cost, audit) by (state before, state after).
Table = dict[tuple[int, int], tuple[int, str]]


def chunk_table(faults: list[int], initials: list[str]) -> Table:
    return {(s, t): way for s in range(4) for t, way in search(faults, initials, s, set(range(4))).items()}


def product(first: Table, second: Table) -> Table:
    """The ways through both, by every state in between."""
    out: Table = {}
    for (s, k), (c, a) in first.items():
        for (m, t), (d, b) in second.items():
            if k == m:
                way = (c + d, a + b)
                if (s, t) not in out or way < out[s, t]:
                    out[s, t] = way
    return out


def products(tables: list[Table]) -> Table:
    """All tables multiplied in order, as a tree."""
    while len(tables) > 1:
        tables = [product(tables[i], tables[i + 1]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0] if tables else {(s, s): (0, "") for s in range(4)}


class Summary:
    """Counts over rows in order; those of two ranges add up."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, initial: str, kind: int) -> None:
        self.blank += kind == BLANK
        self.duplicate += kind == DUPLICATE
        self.truncated += kind == CUT
        self._meet(initial)
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def _meet(self, initial: str) -> None:
        self.illegal += self.last is not None and self.last + initial not in LEGAL

    def extend(self, other: Summary) -> None:
        """The summary of the rows that follow."""
        if other.first is not None:
            self._meet(other.first)
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.turns -= other.low is not None and other.low == self.high
        self.first, self.low = (x if x is not None else y for x, y in ((self.first, other.first), (self.low, other.low)))
        self.last, self.high = (y if y is not None else x for x, y in ((self.last, other.last), (self.high, other.high)))

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LONGEST)

    def values(self) -> dict:
        return {name: getattr(self, name) for name in self.FIELDS}

    @classmethod
    def of(cls, values: dict) -> Summary:
        out = cls()
        for name in cls.FIELDS:
            setattr(out, name, values[name])
        return out


class Repaired:
    """The digest of repaired rows, which come one by one past their audit."""

    def __init__(self, audit: str, keep: bool = False):
        self.audit, self.at, self.state, self.hash, self.rows = audit, 0, START, hashlib.sha256(), [] if keep else None
        self.written = False

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
        self.written = True
        if self.rows is not None:
            self.rows.append((role, text))

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = following(self.state)
            self._write("assistant" if self.state == ASSISTANT else "user", "")

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = kept_state(self.state, role[:1])
            self._write(role, text)
        elif edit == "R":
            self.state = following(self.state)
            self._write("assistant" if self.state == ASSISTANT else "user", text)

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def repair(rows: Iterable[tuple[int | None, str, str]]) -> tuple[Summary, int, str, Repaired]:
    """(counts, cost, audit, repaired rows) of one conversation's sorted (turn, role, text)."""
    rows = list(rows)
    counts, seen, faults = Summary(), set(), []
    for turn, role, text in rows:
        faults.append(fault(text, (role, text) in seen))
        seen.add((role, text))
        counts.add(turn, role[:1], faults[-1])
    cost, audit = best_audit(faults, [role[:1] for _, role, _ in rows])
    out = Repaired(audit, keep=True)
    for _, role, text in rows:
        out.row(role, text)
    return counts, cost, audit, out


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_OUT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
#: Rows that a worker unpacks at once, by number and bytes.
_UNPACK = 256


def _unpacked(batches, columns: int):
    for batch in batches:
        for low in range(0, batch.num_rows, _UNPACK):
            part = batch.slice(low, _UNPACK)
            yield from zip(*(part.column(k).to_pylist() for k in range(columns)), strict=True)


def _sorted(rows: DataFrame, *order: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def repair_whole(rows: DataFrame) -> DataFrame:
    """Conversations that fit into a worker each; ``gone`` rows only say that a conversation was there."""

    def run(batches):
        now, held, ready = object(), [], []

        def flush():
            counts, cost, audit, out = repair(held)
            ready.append((now, counts.gaps(), counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, audit, out.digest()))

        begun = False
        for conv, turn, role, text, gone in _unpacked(batches, 5):
            if not begun or conv != now:
                if begun:
                    flush()
                    if len(ready) >= 1000:
                        yield _batches(ready, _OUT)
                        ready.clear()
                now, begun = conv, True
                held.clear()
            if not gone:
                held.append((turn, role, text))
        if begun:
            flush()
        yield _batches(ready, _OUT)

    dealt = rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id")
    return dealt.sortWithinPartitions(*_sorted(dealt, "conv_id", "turn", "role", "text")).mapInArrow(run, SCHEMA)


_PIECE = "conv_id long, part int, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, ways array<struct<s:int,t:int,cost:long,audit:string>>"
_PIECE_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("low", "high", "turns"))]
    + [("ways", pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
)


def _ways(table: Table) -> list[dict]:
    return [{"s": s, "t": t, "cost": c, "audit": a} for (s, t), (c, a) in table.items()]


def repair_long(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Conversations of any length; no task holds one."""
    of = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    there = rows.where(~F.col("gone")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    there = there.withColumns({"_h": F.xxhash64("role", "text"), "_g": F.xxhash64(F.lit(1), "text", "role")})
    # where a row's role and text stand first in its conversation; only those that stand on several turns
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = there.groupBy(F.col("conv_id").alias("_c"), F.col("_h").alias("_fh"), F.col("_g").alias("_fg")).agg(F.min(at).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    marked = there.join(first, of("conv_id", "_c") & of("_h", "_fh") & of("_g", "_fg"), "left").select("conv_id", "turn", "role", "text", "n", F.coalesce(at > F.col("_first"), F.lit(False)).alias("seen"))

    def piece(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        now, begun, counts, tables, faults, initials = None, False, None, [], [], []

        def close():
            tables.append(chunk_table(faults, initials))
            faults.clear()
            initials.clear()
            while len(tables) > 1 and len(tables[-1]) and weights[-1] >= weights[-2]:  # as a binary counter, so that strings are joined log n times
                last, weight = tables.pop(), weights.pop()
                tables[-1], weights[-1] = product(tables[-1], last), weights[-1] + weight

        def flush():
            if faults:
                weights.append(1)
                close()
            return _batches([(now, part, *counts.values().values(), _ways(products(list(tables))))], _PIECE_ARROW)

        weights: list[int] = []
        for conv, turn, role, text, n, seen in _unpacked(batches, 6):
            if not begun or conv != now:
                if begun:
                    yield flush()
                now, begun, counts = conv, True, Summary()
                tables.clear()
                weights.clear()
            for copy in range(n):
                kind = fault(text, seen or copy > 0)
                counts.add(turn, role[:1], kind)
                faults.append(kind)
                initials.append(role[:1])
                if len(faults) >= chunk:
                    weights.append(1)
                    close()
        if begun:
            yield flush()

    def joined(table: pa.Table) -> pa.Table:
        pieces = sorted(table.to_pylist(), key=lambda x: x["part"])
        counts = Summary()
        for x in pieces:
            counts.extend(Summary.of(x))
        ways = products([{(w["s"], w["t"]): (w["cost"], w["audit"]) for w in x["ways"]} for x in pieces])
        cost, audit = min(ways[START, t] for t in (START, ASSISTANT) if (START, t) in ways)
        row = (pieces[0]["conv_id"], counts.gaps(), counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, audit, None)
        return pa.Table.from_batches([_batches([row], _OUT)])

    def digest(batches):
        head, out = None, None
        for conv, kind, _, role, text, n, gaps, blank, duplicate, truncated, illegal, cost in _unpacked(batches, 12):
            if kind == 0:
                if head:
                    yield _batches([(*head, out.audit, out.digest())], _OUT)
                head, out = (conv, gaps, blank, duplicate, truncated, illegal, cost), Repaired(text)
            else:
                for _ in range(n):
                    out.row(role, text)
        if head:
            yield _batches([(*head, out.audit, out.digest())], _OUT)

    order = ("conv_id", "turn", "role", "text")
    ranged = marked.repartitionByRange(*_sorted(marked, *order)).sortWithinPartitions(*_sorted(marked, *order))
    judged = ranged.select(*order, "n", "seen").mapInArrow(piece, _PIECE).groupBy("conv_id").applyInArrow(joined, SCHEMA)
    # a conversation without rows has no piece: an empty audit
    empty = rows.groupBy("conv_id").agg(F.bool_and("gone").alias("e")).where("e").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in _OUT.names[1:7]), F.lit("").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"))
    numbers = _OUT.names[1:7]
    none = F.lit(None).cast("long")
    heads = judged.union(empty).select("conv_id", F.lit(0).alias("kind"), none.alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"), *numbers)
    lines = marked.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n", *(none.alias(c) for c in numbers))
    stream = heads.union(lines).repartition("conv_id")
    return stream.sortWithinPartitions(*_sorted(stream, "conv_id", "kind", "turn", "role", "text")).mapInArrow(digest, SCHEMA)


def repair_conversations(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES, chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text, gone): its counts, cost, audit and digest."""
    size = F.octet_length("text").cast("long") + F.octet_length("role")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    long = sizes.where((F.col("n") > most_rows) | (F.col("b") > most_bytes)).select(F.col("conv_id").alias("_long"))
    if long.isEmpty():
        return repair_whole(rows)
    is_long = F.col("conv_id").eqNullSafe(F.col("_long"))
    return repair_whole(rows.join(long, is_long, "left_anti")).union(repair_long(rows.join(long, is_long, "left_semi"), chunk))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired rows themselves, of conversations that fit into a worker each."""

    def run(batches):
        now, begun, held = None, False, []
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

        def flush():
            out = repair(held)[3]
            out.digest()
            return _batches([(now, k, *row) for k, row in enumerate(out.rows)], schema)

        for conv, turn, role, text, gone in _unpacked(batches, 5):
            if begun and conv != now:
                yield flush()
                held.clear()
            now, begun = conv, True
            if not gone:
                held.append((turn, role, text))
        if begun:
            yield flush()

    dealt = rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id")
    return dealt.sortWithinPartitions(*_sorted(dealt, "conv_id", "turn", "role", "text")).mapInArrow(run, "conv_id long, place long, role string, text string")
