"""Repair of conversation structure by cheapest edits, found by iterative-deepening A*.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles.  Edits of its rows, in
order: Keep (0), Rerole to user or assistant (1), Delete (2), Insert an empty user or assistant
turn (5); blank and duplicate rows must be deleted, a truncated row that stays costs 5 more.

The search goes depth first through edits in ASCII order (D, I, K, R) under a cost bound, which
rises to the least estimate that exceeded it.  A state is (row, what the grammar has read); a
table keeps, for each state, the largest remaining cost with which it failed.  The first
accepting path under the final bound is the cheapest one, and the ASCII-least of those.

Spark brings each conversation's rows together in order and finds the faults; a task reads them as
a sorted stream.  Long conversations are searched in pieces of ``PIECE`` rows, for every state
of the grammar in which a piece may begin and end; all edits of a piece end with one of its
last row, so no piece's edits are a prefix of another choice's and the least ones of the pieces give the
least whole.  A piece is written out as soon as all paths still open agree on it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

PIECE = 16
#: States: nothing read, system, user, assistant read last; a conversation may end in the first or the last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What follows a state by reading s, u or a.
NEXT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
#: Kinds of rows as the search sees them: initials of plain rows in lower case (x: any other), of truncated ones in upper case; a hyphen must go.
REROLE, DELETE, INSERT, STAY = 1, 2, 5, 5


def _estimates(kinds: str) -> list[int]:
    """Least cost of the rows from each one on: faulty rows, other initials, and disjoint illegal neighbours among plain rows."""
    n = len(kinds)
    least, after, then = [0] * (n + 1), 0, 0
    follow = ""  # the next plain row's initial
    # ``after``: most disjoint pairs from the next plain row on; ``then``: from the one behind it.
    singles = 0
    for i in range(n - 1, -1, -1):
        k = kinds[i]
        if k == "-" or k.isupper():
            singles += DELETE
        elif k == "x":
            singles += REROLE
            after, then, follow = max(after, then), max(after, then), ""
        else:
            pair = 1 + then if follow and k + follow not in LEGAL else 0
            after, then, follow = max(after, pair), after, k
        least[i] = singles + after
    return least


@lru_cache(maxsize=1 << 16)
def cheapest(kinds: str, start: int, goals: tuple[int, ...], last: bool) -> tuple[int, str] | None:
    """Least cost and ASCII-least edits that take the rows from state ``start`` to one of ``goals``; None if there are none.

    Unless ``last``, nothing is inserted after the last row.
    """
    n, least = len(kinds), _estimates(kinds)
    if not last and not (set(goals) & _reachable(kinds, start)):
        return None
    bound = least[0]
    while True:
        failed: dict[tuple[int, int], int] = {}
        above = math.inf
        path: list[str] = []
        # Frames of the depth-first search: (row, state, cost so far, edits left to try).
        stack = [(0, start, 0, None)]
        while stack:
            i, q, cost, tries = stack.pop()
            if tries is None:
                if i == n and q in goals:
                    return cost, "".join(path)
                if failed.get((i, q), -1) >= bound - cost:
                    if path:
                        path.pop()
                    continue
                tries = _edits(kinds, i, q, last)
            for at in range(len(tries)):
                letter, j, r, price = tries[at]
                estimate = cost + price + least[j]
                if estimate > bound:
                    above = min(above, estimate)
                    continue
                stack.append((i, q, cost, tries[at + 1 :]))
                stack.append((j, r, cost + price, None))
                path.append(letter)
                break
            else:
                failed[i, q] = max(failed.get((i, q), -1), bound - cost)
                if path:
                    path.pop()
        bound = above


def _reachable(kinds: str, start: int) -> set[int]:
    ends = {USER, ASSISTANT}
    if start in (NONE, SYSTEM):
        ends.add(start)
    if start == NONE and ("s" in kinds or "S" in kinds):
        ends.add(SYSTEM)
    return ends


def _edits(kinds: str, i: int, q: int, last: bool) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, next row, next state, cost) in ASCII order."""
    out, wanted = [], "a" if q == USER else "u"
    row = i < len(kinds)
    if row:
        out.append(("D", i + 1, q, DELETE))
    if row or last:
        out.append(("I", i, NEXT[wanted][q], INSERT))
    if row and kinds[i] != "-":
        stay = STAY if kinds[i].isupper() else 0
        kept = NEXT.get(kinds[i].lower(), {}).get(q)
        if kept is not None:
            out.append(("K", i + 1, kept, stay))
        out.append(("R", i + 1, NEXT[wanted][q], REROLE + stay))
    return tuple(out)


def replay(edits: str, rows: list[tuple[str, str]], state: int) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the turns that edits of ``rows`` (role, text) leave."""
    at = 0
    for letter in edits:
        wanted = "assistant" if state == USER else "user"
        if letter == "I":
            yield letter, wanted, ""
            state = NEXT[wanted[0]][state]
            continue
        role, text = rows[at]
        at += 1
        if letter == "D":
            continue
        if letter == "R":
            role = wanted
        yield letter, role, text
        state = NEXT[role[:1]][state]


class Repair:
    """One conversation, read row by row; turns come out as soon as they are certain."""

    def __init__(self):
        self.rows: list[tuple[str, str]] = []
        self.kinds: list[str] = []
        # Paths open at the end of the pieces read: state -> cost; pieces not written yet: (rows, {state: (state before, edits)}).
        self.open: dict[int, int] = {NONE: 0}
        self.pieces: list[tuple[list, dict[int, tuple[int, str]]]] = []
        self.done, self.state = [], NONE
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.previous: str | None = None
        self.turn, self.first, self.turns = None, None, 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> Iterator[tuple[str, str, str]]:
        if len(self.rows) == PIECE:
            yield from self._piece()
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        if self.previous is not None and self.previous + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.previous = initial
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        kind = initial if initial in ("s", "u", "a") else "x"
        self.kinds.append("-" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
        self.rows.append((role, text))

    def _piece(self) -> Iterator[tuple[str, str, str]]:
        kinds = "".join(self.kinds)
        best: dict[int, tuple[int, str, int, str]] = {}
        for goal in range(4):
            options = []
            for q, cost in self.open.items():
                found = cheapest(kinds, q, (goal,), False)
                if found:
                    options.append((cost + found[0], q, found[1]))
            if options:
                least = min(o[0] for o in options)
                # Of equal cost, the least whole list of edits: compare the open pieces before, then this one.
                best[goal] = min(((self._edits_to(q) + edits, q, edits) for c, q, edits in options if c == least))[1:] + (least,)
        self.pieces.append((self.rows, {g: (q, edits) for g, (q, edits, _) in best.items()}))
        self.open = _worth({g: cost for g, (_, _, cost) in best.items()})
        self.rows, self.kinds = [], []
        yield from self._agreed()

    def _edits_to(self, state: int) -> str:
        out = []
        for _, table in reversed(self.pieces):
            state, edits = table[state]
            out.append(edits)
        return "".join(reversed(out))

    def _agreed(self) -> Iterator[tuple[str, str, str]]:
        """Write out the pieces on which all open paths agree."""
        states, agreed = set(self.open), 0
        chain = []
        for i in range(len(self.pieces) - 1, -1, -1):
            if len(states) == 1:
                agreed = i + 1
                break
            states = {self.pieces[i][1][q][0] for q in states}
        if not agreed:
            return
        state = next(iter(states))
        for rows, table in reversed(self.pieces[:agreed]):
            state, edits = table[state]
            chain.append((rows, edits))
        self.pieces = self.pieces[agreed:]
        for rows, edits in reversed(chain):
            yield from self._write(rows, edits)

    def _write(self, rows: list[tuple[str, str]], edits: str) -> Iterator[tuple[str, str, str]]:
        self.done.append(edits)
        for letter, role, text in replay(edits, rows, self.state):
            self.state = NEXT[role[:1]][self.state]
            yield letter, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        """The remaining turns; ``cost`` and ``audit`` are set afterwards."""
        kinds = "".join(self.kinds)
        options = []
        for q, cost in self.open.items():
            found = cheapest(kinds, q, (NONE, ASSISTANT), True)
            options.append((cost + found[0], self._edits_to(q) + found[1], q, found[1]))
        self.cost, _, q, edits = min(options)
        chain = [(self.rows, edits)]
        for rows, table in reversed(self.pieces):
            q, edits = table[q]
            chain.append((rows, edits))
        for rows, edits in reversed(chain):
            yield from self._write(rows, edits)
        self.audit = "".join(self.done)

    def gaps(self) -> int:
        return 0 if self.first is None else self.turn - self.first + 1 - self.turns


def _worth(paths: dict[int, int]) -> dict[int, int]:
    """Paths that can still be the cheapest: what a state can do, another one can do at a known extra cost."""
    instead = {(NONE, ASSISTANT): DELETE, (SYSTEM, ASSISTANT): 0, (USER, ASSISTANT): INSERT, (ASSISTANT, USER): INSERT}
    return {q: c for q, c in paths.items() if not any(a == q and b in paths and paths[b] + extra < c for (a, b), extra in instead.items())}


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv", "position", "edit", "role", "text", *_REPORT, "audit")
    types, out = None, {c: [] for c in names}
    now, repair, position = (), None, 0

    def turns(rows):
        nonlocal position
        for letter, role, text in rows:
            for c, v in zip(names, (now[0], position, letter, role, text, *[None] * len(_REPORT), None), strict=True):
                out[c].append(v)
            position += 1

    def close():
        turns(repair.end())
        report = [repair.gaps(), *repair.counts.values(), repair.cost]
        for c, v in zip(names, (now[0], None, None, None, None, *report, repair.audit), strict=True):
            out[c].append(v)

    def flush():
        nonlocal out
        full, out = out, {c: [] for c in names}
        return pa.RecordBatch.from_arrays([pa.array(full[c], t) for c, t in zip(names, types, strict=True)], list(names))

    for batch in batches:
        types = types or [batch.schema.field("conv").type, pa.int64(), *[pa.string()] * 3, *[pa.int64()] * len(_REPORT), pa.string()]
        for conv, turn, role, text, gone, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone", "fault")), strict=True):
            if now != (conv,):
                if repair is not None:
                    close()
                now, repair, position = (conv,), Repair(), 0
            if not gone:
                turns(repair.add(turn, role, text, fault))
            if len(out["conv"]) >= 4096:
                yield flush()
    if repair is not None:
        close()
    if types and out["conv"]:
        yield flush()


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """Repaired turns and one report for each conversation: (conv, position, edit, role, text, gaps, blank, duplicate, truncated, illegal, cost, audit).

    A turn that stays has a ``position`` from 0 and its ``edit`` (K, R or I); the report has
    neither, and follows its conversation's turns.  Rows are taken by turn (null first), then role and text; null
    role or text is one space.  Each row has at most one fault: blank, duplicate (its role and text
    stood earlier in the conversation), truncated (its last character is none of ``.!?``), white
    space (space, U+0009 to U+000D) aside.  ``illegal`` counts neighbours whose initials are not su, ua or au,
    ``gaps`` the missing turn numbers.  Rows with ``gone_col`` true are not there, but their
    conversation is reported.  Equal rows are duplicates of each other; a null conversation is one; no rows give no rows.
    """
    space = lambda c: F.coalesce(rows[c], F.lit(" "))
    gone = F.coalesce(rows[gone_col], F.lit(False)) if gone_col else F.lit(False)
    source = rows.select(rows[conv_col].alias("conv"), rows[turn_col].cast("long").alias("turn"), space(role_col).alias("role"), F.when(~gone, space(text_col)).alias("text"), gone.alias("gone"))
    same = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    source = source.withColumn("same", F.when(~F.col("gone"), same)).repartition("conv")
    # One shuffle: rows of one conversation are together for the window and for the stream.
    source = source.withColumn("again", F.row_number().over(Window.partitionBy("conv", "same").orderBy("turn")) > 1)
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.col("again"), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
        .otherwise("")
    )
    source = source.withColumn("fault", F.coalesce(fault, F.lit("")))
    ordered = source.sortWithinPartitions("conv", "turn", "role", "text", "again").select("conv", "turn", "role", "text", "gone", "fault")
    kind = source.schema["conv"].dataType.simpleString()
    report = ", ".join(f"{c} long" for c in _REPORT)
    return ordered.mapInArrow(_repair, f"conv {kind}, position long, edit string, role string, text string, {report}, audit string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = hashlib.sha256()
    for batch in batches:
        digests = []
        for position, role, text in zip(*(batch.column(c).to_pylist() for c in ("position", "role", "text")), strict=True):
            if position is None:
                digests.append(state.hexdigest())
                state = hashlib.sha256()
            else:
                state.update(("\n" if position else "").encode() + f"{role}:{text}".encode())
        reports = batch.filter(pc.is_null(batch.column("position")))
        if reports.num_rows:
            names = ["conv", *_REPORT, "audit"]
            yield pa.RecordBatch.from_arrays([*(reports.column(c) for c in names), pa.array(digests, pa.string())], [*names, "repaired_sha256"])


def repair_digests(repaired: DataFrame) -> DataFrame:
    """Reports with the digest of each conversation's turns (``role:text``, joined by line feeds).

    ``repaired`` must be the very result of ``repair_conversations``, whose order the digest follows; no shuffle lies between.
    """
    kind = repaired.schema["conv"].dataType.simpleString()
    report = ", ".join(f"{c} long" for c in _REPORT)
    return repaired.mapInArrow(_digest, f"conv {kind}, {report}, audit string, repaired_sha256 string")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults (conv_id, turn, role, text, gone), by crc32 of ``conv:turn`` (null: one space) modulo 20.

    0 drops a row (``gone``), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    text = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    case = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20
    out = rows.select(rows[conv_col].alias("conv_id"), rows[turn_col].alias("turn"), rows[role_col].alias("role"), rows[text_col].alias("text"), case.alias("case"))
    changed = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", role.alias("role"), changed.alias("text"), (F.col("case") == 0).alias("gone"), copies.alias("copy")).drop("copy")
