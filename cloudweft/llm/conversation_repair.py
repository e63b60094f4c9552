"""Conversations brought into the shape system? (user assistant)+ by the cheapest edits, with survivor-coalescence Viterbi.

A conversation is read turn by turn. Four states say what the repaired turns end with: nothing, a system turn, a user turn,
an assistant turn. Each state keeps its cheapest sequence of edits, of equally cheap ones the least in ASCII order, as a leaf of
one tree of back pointers. Nodes count who refers to them and go with the last reference. As soon as all leaves descend
from one node, what leads to it is final and is handed on, so a task holds the unresolved ends only, however long the
conversation is. Ties are decided on the whole unresolved ends, whose order is carried along. (Some ties stay open: in a run
of user turns alone an early insertion competes with a late one to the end of the run, and so long its ends are held.)

Two sequences for the same turns never are one the beginning of the other at equal cost (more insertions cost more), so their
order is not changed by what follows, and a state's best sequence extends the best ones before it. A state is left out only if
it costs more than what the assistant state needs to make up for anything it could do: 4 more for nothing, 0 for a system turn.

Spark brings each conversation's turns together in order with one shuffle; duplicates are found by a window in the same
partitioning. The digest of a repaired conversation is a hash over all of it in order, so one task reads a conversation
through, as a stream: a conversation with a third of all turns takes one task as long as hashing it needs, but no more memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed by the format: what counts as blank, and how a finished turn ends.
BLANK, ENDS = r"[\x20\x09-\x0D]", "[.!?]"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn with this initial, for each state before it.
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What a changed or an inserted turn has to be.
WANTED = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
KEEPS, FORCED, CUT = range(3)


class _Node:
    """One edit: its initial, the turn it leaves (None: deleted), and the edit before it."""

    __slots__ = ("up", "letter", "turn", "refs", "kids", "depth")

    def __init__(self, up: _Node | None, letter: str = "", turn: tuple | None = None):
        self.up, self.letter, self.turn, self.refs, self.kids, self.depth = up, letter, turn, 0, [], up.depth + 1 if up else 0
        if up:
            up.kids.append(self)
            up.refs += 1

    def release(self) -> None:
        """One reference less; nodes that nobody refers to go, and with them their references."""
        at = self
        at.refs -= 1
        while not at.refs and at.up:
            up = at.up
            up.kids.remove(at)
            up.refs -= 1
            at.up, at = None, up


class _Order:
    """Which of two sequences comes first, each given as an end that is known and the letters after it.

    The order of the known ends is carried from turn to turn, so that a tie over any unresolved length takes no walk back: ends
    that differ somewhere keep their order whatever follows, and for an end that begins another one ``tails`` has the rest.
    """

    def __init__(self):
        self.rank: dict[int, int] = {NOTHING: 0}
        self.tails: dict[tuple[int, int], str] = {}

    def less(self, p: int, s: str, q: int, t: str) -> bool:
        if p == q:
            return s < t
        if (p, q) in self.tails:
            return s < self.tails[p, q] + t
        if (q, p) in self.tails:
            return self.tails[q, p] + s < t
        return self.rank[p] < self.rank[q]

    def tail(self, p: int, s: str, q: int, t: str) -> str | None:
        """What the second sequence has after the first, if it begins with it."""
        if p != q:
            if (p, q) in self.tails:
                t = self.tails[p, q] + t
            elif (q, p) in self.tails:
                s = self.tails[q, p] + s
            else:
                return None
        return t[len(s) :] if t.startswith(s) else None

    def after(self, ends: dict[int, tuple[int, str]]) -> _Order:
        """The order of the next ends, which are given as the ends known here and letters."""
        new = _Order()
        new.rank = {x: sum(self.less(*ends[y], *ends[x]) for y in ends if y != x) for x in ends}
        pairs = ((x, y, self.tail(*ends[x], *ends[y])) for x in ends for y in ends if x != y)
        new.tails = {(x, y): rest for x, y, rest in pairs if rest is not None}
        return new


class Repair:
    """Takes turns one by one and hands out the edits that are final: (initial, (role, text) or None)."""

    def __init__(self):
        self.root, self.order, self.cost = _Node(None), _Order(), 0
        self.longest = 0  # the most edits unresolved at once
        self.root.refs = 1
        self.leaves: dict[int, tuple[int, _Node]] = {NOTHING: (0, self.root)}
        self._settle({NOTHING: (0, self.root, NOTHING, "")})

    def _settle(self, best: dict[int, tuple[int, _Node, int, str]]) -> None:
        """Turns inserted after the candidates (cost, node, known end and letters), which become the leaves in place of those before."""
        for _ in range(2):  # two rounds reach every state from any other
            for state in [s for s in (NOTHING, SYSTEM, USER, ASSISTANT) if s in best]:
                cost, node, p, s = best[state]
                role, to = WANTED[state]
                old = best.get(to)
                if old is None or cost + INSERT < old[0] or cost + INSERT == old[0] and self.order.less(p, s + "I", *old[2:]):
                    new = _Node(node, "I", (role, ""))
                    new.refs += 1
                    best[to] = (cost + INSERT, new, p, s + "I")
                    if old:
                        old[1].release()
        least = best[ASSISTANT][0]
        for state, more in ((NOTHING, DELETE), (SYSTEM, 0)):
            if state in best and best[state][0] > least + more:
                best.pop(state)[1].release()
        self.order = self.order.after({state: x[2:] for state, x in best.items()})
        self.leaves = {state: x[:2] for state, x in best.items()}

    def _resolved(self) -> Iterator[tuple[str, tuple | None]]:
        while self.root.refs == 1 and self.root.kids:
            (kid,) = self.root.kids
            kid.up = None
            self.root = kid
            yield kid.letter, kid.turn
        self.longest = max(self.longest, max(node.depth for _, node in self.leaves.values()) - self.root.depth)

    def turn(self, role: str, text: str, fault: int) -> Iterator[tuple[str, tuple | None]]:
        """``fault``: FORCED where the turn has to go, CUT where it is truncated, else KEEPS."""
        best: dict[int, tuple] = {}
        more = TRUNCATED if fault == CUT else 0

        def offer(to: int, cost: int, state: int, letter: str, turn: tuple | None) -> None:
            old = best.get(to)
            if old is None or cost < old[0] or cost == old[0] and self.order.less(state, letter, *old[1:3]):
                best[to] = (cost, state, letter, turn)

        for state, (cost, _) in self.leaves.items():
            offer(state, cost + DELETE, state, "D", None)
            if fault != FORCED:
                if role[:1] in NEXT[state]:
                    offer(NEXT[state][role[:1]], cost + more, state, "K", (role, text))
                wanted, to = WANTED[state]
                offer(to, cost + REROLE + more, state, "R", (wanted, text))
        chosen = {}
        for to, (cost, state, letter, turn) in best.items():
            node = _Node(self.leaves[state][1], letter, turn)
            node.refs += 1
            chosen[to] = (cost, node, state, letter)
        for _, node in self.leaves.values():
            node.release()
        self._settle(chosen)
        yield from self._resolved()

    def end(self) -> Iterator[tuple[str, tuple | None]]:
        """The edits left; ``cost`` is final afterwards."""
        best = ASSISTANT
        if NOTHING in self.leaves and (self.leaves[NOTHING][0], self.order.rank[NOTHING]) < (self.leaves[best][0], self.order.rank[best]):
            best = NOTHING
        self.cost, at = self.leaves[best]
        path = []
        while at is not self.root:
            path.append((at.letter, at.turn))
            at = at.up
        yield from reversed(path)


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, place, dropped): turns with a fault in a quarter of them, drawn by crc32 of ``conv_id:turn``.

    Null roles and texts become one space, and a null id or turn counts as one space in the draw. ``place`` orders rows of the
    same turn. Dropped rows stay, marked, so that no conversation is lost.
    """
    blank = F.lit(" ")
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(role_col, blank).alias("role"), F.coalesce(text_col, blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    draw = F.crc32(key) % 20
    rows = rows.withColumn("__draw", draw).withColumn("place", F.struct("role", "text"))
    rows = rows.withColumn("text", F.when(F.col("__draw") == 1, "").when(F.col("__draw") == 2, F.regexp_replace("text", ENDS, "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("__draw") == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.when(F.col("__draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("__copy", copies).select("conv_id", "turn", "role", "text", "place", (F.col("__draw") == 0).alias("dropped"))


def ordered(turns: DataFrame) -> DataFrame:
    """Turns partitioned by conversation and in order (turn, nulls first, then place), each with its first fault.

    ``turns``: conv_id, turn, role, text, place (orders rows of one turn; rows equal in all of it are interchangeable), dropped.
    The faults are ``blank``, ``duplicate`` (role and text stood earlier), ``truncated`` or null.
    """
    rows = turns.withColumn("same", F.when(~F.col("dropped"), F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256)))
    rows = rows.repartition("conv_id")
    first = Window.partitionBy("conv_id", "same").orderBy("turn", "place")
    rows = rows.withColumn("again", F.row_number().over(first) > 1)
    fault = (
        F.when(F.col("dropped"), None).when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("again"), "duplicate")
        .when(~F.col("text").rlike(rf"{ENDS}{BLANK}*\z"), "truncated")
    )
    rows = rows.select("conv_id", "turn", "place", "role", "text", "dropped", fault.alias("fault"), "again")
    return rows.sortWithinPartitions("conv_id", "turn", "place", "again").select("conv_id", "turn", "role", "text", "dropped", "fault")


class _Audit:
    """What is told of one conversation."""

    def __init__(self):
        self.repair, self.letters, self.sha, self.kept = Repair(), bytearray(), hashlib.sha256(), 0
        self.first = self.last = None
        self.turns, self.illegal, self.before = 0, 0, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def take(self, edits) -> list[tuple]:
        out = []
        for letter, turn in edits:
            self.letters += letter.encode()
            if turn:
                role, text = turn
                self.sha.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                self.kept += 1
            out.append((letter, *(turn or (None, None))))
        return out

    def turn(self, turn, role, text, fault) -> list[tuple]:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if fault:
            self.faults[fault] += 1
        return self.take(self.repair.turn(role, text, FORCED if fault in ("blank", "duplicate") else CUT if fault else KEEPS))

    def end(self) -> list[tuple]:
        return self.take(self.repair.end())

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, self.repair.cost, self.letters.decode(), self.sha.hexdigest()


def _walked(it, each: bool) -> Iterator[tuple[list, list[tuple]]]:
    """Of each batch: rows (conv_id, ...) that are final, edits if ``each``, else one audit for each conversation."""
    now, audit, step = None, None, 0

    def said(edits: list[tuple]) -> list[tuple]:
        nonlocal step
        step += len(edits)
        return [(now[0], step - len(edits) + k + 1, *e) for k, e in enumerate(edits)] if each else []

    def closed() -> list[tuple]:
        last = said(audit.end())
        return last if each else [(now[0], *audit.row())]

    for b in it:
        out = []
        for conv, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or now[0] != conv:
                if now:
                    out += closed()
                now, audit, step = (conv,), _Audit(), 0
            if not dropped:
                out += said(audit.turn(turn, role, text, fault))
        if out:
            yield out
    if now:
        yield closed()


def _run(turns: DataFrame, each: bool, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    rows = ordered(turns)
    kind = turns.schema["conv_id"].dataType

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(kind), *(t for _, _, t in fields)]
        for out in _walked(it, each):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", *(name for name, _, _ in fields)])

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, " + ", ".join(f"{name} {sql}" for name, sql, _ in fields))


def edits(turns: DataFrame) -> DataFrame:
    """(conv_id, step, edit, role, text): the cheapest edits of each conversation in order, with the turns that they leave.

    ``turns`` is as ``ordered`` takes it. Edits are K(eep), R(erole), D(elete, role and text null) and I(nsert, empty text).
    """
    return _run(turns, True, [("step", "bigint", pa.int64()), ("edit", "string", pa.string()), ("role", "string", pa.string()), ("text", "string", pa.string())])


def audits(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns`` (as ``ordered`` takes it): gaps, blank, duplicate, truncated, illegal, cost,
    audit (the initials of the edits) and repaired_sha256 (of ``role:text`` of the repaired turns, joined by line ends).

    Defined results: null ids are one conversation; one without turns (all dropped) has zeros, an empty audit and the hash of an
    empty text; null turns come first and count for no gap; repeated rows are duplicates; a turn whose role is empty or starts
    with another letter than s, u or a can't be kept as it is. An empty table gives no rows.
    """
    counts = [(c, "bigint", pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return _run(turns, False, [*counts, ("audit", "string", pa.string()), ("repaired_sha256", "string", pa.string())])
