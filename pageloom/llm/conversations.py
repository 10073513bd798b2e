"""Conversation structure repair: the cheapest edits that give every conversation legal turns.

A conversation of n rows is a lattice of (rows used, grammar state). Edits are its edges: Keep a row, Rerole
it, Delete it, Insert an empty turn. The cheapest path is found from both ends: a forward and a reverse heap
take turns, and once a crossing is known both go on until no further crossing can cost the same. Every
crossing of that cost is looked at and the least concatenated audit (the edits' initials) wins.

Rows are sorted by conversation and turn over all tasks; a task cuts its stretch into pieces of at most
``PIECE`` rows. Most conversations are one piece. Of a longer one, or one that lies in two tasks, each piece
gives the cheapest path from every grammar state to every other, and these 4 x 4 tables are multiplied in
groups of ``FAN``, level by level, until one is left. So no task searches a long conversation whole. The
hash of a repaired conversation can only be computed in order: its rows pass one task as a stream, which
holds one row and the audit at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.shipping import ship
from pageloom.llm.storage import Scratch

PIECE = 1024
FAN = 32

# Costs of the edits, and the grammar of role initials ``(s?(ua)+)?`` as an automaton.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}

STATES = len(STEPS)
BACK = tuple([(s, c) for s, step in enumerate(STEPS) for c, t in step.items() if t == end] for end in range(STATES))
BATCH = 2048

Path = tuple[int, str]


class Turn(NamedTuple):
    """What the lattice needs of a row: its role's initial, whether it must go, whether it is cut short."""

    initial: str
    banned: bool
    truncated: bool


def _onward(turns: list[Turn], node: int) -> Iterator[tuple[int, int, str]]:
    """(node, cost, letter) of every edit that leaves a node, which is rows used * STATES + state."""
    i, state = divmod(node, STATES)
    if i < len(turns):
        turn = turns[i]
        yield node + STATES, DELETE, "D"
        if not turn.banned:
            extra = TRUNCATED * turn.truncated
            for initial, after in STEPS[state].items():
                if initial == turn.initial:
                    yield (i + 1) * STATES + after, extra, "K"
                elif initial in NAMES:
                    yield (i + 1) * STATES + after, REROLE + extra, "R"
    for initial, after in STEPS[state].items():
        if initial in NAMES:
            yield i * STATES + after, INSERT, "I"


def _back(turns: list[Turn], node: int) -> Iterator[tuple[int, int, str]]:
    """(node, cost, letter) of every edit that leads to a node."""
    i, state = divmod(node, STATES)
    if i:
        turn = turns[i - 1]
        yield node - STATES, DELETE, "D"
        if not turn.banned:
            extra = TRUNCATED * turn.truncated
            for before, initial in BACK[state]:
                if initial == turn.initial:
                    yield (i - 1) * STATES + before, extra, "K"
                elif initial in NAMES:
                    yield (i - 1) * STATES + before, REROLE + extra, "R"
    for before, initial in BACK[state]:
        if initial in NAMES:
            yield i * STATES + before, INSERT, "I"


def cheapest(turns: list[Turn], start: int = 0, ends: Iterable[int] = ENDS) -> Path | None:
    """Cost and least audit of the cheapest edits from state ``start`` to one of ``ends``; None if there are none.

    Two audits of equal cost that lead to the same node never begin one another, since the longer one would
    have more inserts; so the least of a whole path is made of least parts. Nodes of equal cost are settled in
    the order of rows used (from the far end in reverse), because edits that cost nothing use a row.
    """
    n = len(turns)
    goals = {n * STATES + e for e in ends}
    ahead: dict[int, Path] = {start: (0, "")}
    behind: dict[int, Path] = dict.fromkeys(goals, (0, ""))
    front, rear = [(0, 0, start)], [(0, 0, g) for g in goals]
    done_ahead: set[int] = set()
    done_behind: set[int] = set()
    best: Path | None = None

    def crossed(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = (cost, audit)

    while front and rear:
        if best is not None and front[0][0] + rear[0][0] > best[0]:
            break
        if front[0][0] <= rear[0][0]:
            _, _, node = heapq.heappop(front)
            if node in done_ahead:
                continue
            done_ahead.add(node)
            cost, audit = ahead[node]
            if node in goals:
                crossed(cost, audit)
            for after, price, letter in _onward(turns, node):
                reach = (cost + price, audit + letter)
                if after in done_behind:
                    rest = behind[after]
                    crossed(reach[0] + rest[0], reach[1] + rest[1])
                if after not in done_ahead and (after not in ahead or reach < ahead[after]):
                    ahead[after] = reach
                    heapq.heappush(front, (reach[0], after // STATES, after))
        else:
            _, _, node = heapq.heappop(rear)
            if node in done_behind:
                continue
            done_behind.add(node)
            cost, audit = behind[node]
            if node == start:
                crossed(cost, audit)
            for before, price, letter in _back(turns, node):
                reach = (cost + price, letter + audit)
                if before in done_ahead:
                    first = ahead[before]
                    crossed(first[0] + reach[0], first[1] + reach[1])
                if before not in done_behind and (before not in behind or reach < behind[before]):
                    behind[before] = reach
                    heapq.heappush(rear, (reach[0], n - before // STATES, before))
    return best


class Piece(NamedTuple):
    """A stretch of one conversation: its counts, and paths[a * STATES + b] from state a to state b."""

    rows: int
    low: int | None
    high: int | None
    distinct: int
    first_turn: int | None
    last_turn: int | None
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first_role: str | None
    last_role: str | None
    costs: list[int | None]
    audits: list[str | None]


def _illegal(left: str | None, right: str | None) -> int:
    return int(left is not None and right is not None and left + right not in LEGAL)


def piece_of(rows: list[tuple[int | None, Turn, str]], whole: bool) -> Piece:
    """The piece of (turn number, turn, fault) rows; a whole conversation only needs paths from start to end."""
    turns = [r[1] for r in rows]
    numbers = [r[0] for r in rows if r[0] is not None]
    faults = [r[2] for r in rows]
    initials = [t.initial for t in turns]
    paths: list[Path | None] = [None] * STATES**2
    if whole:
        best = cheapest(turns)
        state = ENDS[0] if best and not best[1].strip("D") else ENDS[1]
        paths[state] = best
    else:
        paths = [cheapest(turns, a, (b,)) for a in range(STATES) for b in range(STATES)]
    return Piece(
        len(rows),
        min(numbers, default=None),
        max(numbers, default=None),
        len(set(numbers)),
        rows[0][0] if rows else None,
        rows[-1][0] if rows else None,
        *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
        sum(_illegal(a, b) for a, b in zip(initials, initials[1:], strict=False)),
        initials[0] if rows else None,
        initials[-1] if rows else None,
        [p and p[0] for p in paths],
        [p and p[1] for p in paths],
    )


def joined(left: Piece, right: Piece) -> Piece:
    """Two neighbouring pieces as one."""
    if not left.rows:
        return right
    if not right.rows:
        return left
    paths: list[Path | None] = []
    for a in range(STATES):
        for b in range(STATES):
            found = [
                (left.costs[a * STATES + m] + right.costs[m * STATES + b], left.audits[a * STATES + m] + right.audits[m * STATES + b])
                for m in range(STATES)
                if left.costs[a * STATES + m] is not None and right.costs[m * STATES + b] is not None
            ]
            paths.append(min(found, default=None))
    lows = [x for x in (left.low, right.low) if x is not None]
    highs = [x for x in (left.high, right.high) if x is not None]
    shared = left.last_turn is not None and left.last_turn == right.first_turn
    return Piece(
        left.rows + right.rows,
        min(lows, default=None),
        max(highs, default=None),
        left.distinct + right.distinct - shared,
        left.first_turn,
        right.last_turn,
        left.blank + right.blank,
        left.duplicate + right.duplicate,
        left.truncated + right.truncated,
        left.illegal + right.illegal + _illegal(left.last_role, right.first_role),
        left.first_role,
        right.last_role,
        [p and p[0] for p in paths],
        [p and p[1] for p in paths],
    )


PIECE_FIELDS = (
    "rows long, low long, high long, distinct long, first_turn long, last_turn long, blank long, duplicate long, "
    "truncated long, illegal long, first_role string, last_role string, costs array<long>, audits array<string>"
)
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_PIECE_TYPES = [_ARROW[f.split()[1]] for f in PIECE_FIELDS.split(", ")]
_FACTS = Piece._fields


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays, marked ``gone``), 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes
    it a user's. A null counts as one space, in that key too; conv_id and turn themselves stay null.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    code = F.col("code")
    text = F.coalesce("text", blank)
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("code")
    )
    cut = F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        cut.alias("text"),
        (code == 0).alias("gone"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def _narrow(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, what is wrong with them, and when the same was first said."""
    space = "[\\x20\\x09-\\x0D]"
    ended = F.regexp_replace("text", f"{space}+$", "")
    kept = rows.where(~F.col("gone")).select(
        "conv_id",
        "turn",
        "role",
        "digest",
        (~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).alias("blank"),
        (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    counted = kept.groupBy("conv_id", "turn", "role", "digest").agg(
        F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.count("*").alias("n")
    )
    # Only what was said in several turns has to be told of; a struct orders null turns first.
    when = F.struct(F.col("turn").isNotNull(), "turn")
    again = counted.groupBy("conv_id", "digest").agg(F.min(when)["turn"].alias("first"), F.count("*").alias("turns"))
    again = again.where("turns > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first", "turns")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    later = F.col("turns").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    return counted.join(again, same, "left").select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", "digest", "blank", "truncated", "n", later.alias("later")
    )


def _pieces(narrow: DataFrame) -> DataFrame:
    """Pieces of the sorted rows: conv_id, part and seq (their order), whole, and the fields of a piece."""
    ordered = narrow.repartitionByRange(F.col("conv_id").asc_nulls_first(), *_order())
    ordered = ordered.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order())
    ordered = ordered.withColumn("part", F.spark_partition_id()).drop("role", "digest")
    conv_type = narrow.schema["conv_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "seq", "whole", *_FACTS]
        out: list[list] = [[] for _ in names]
        held: list[tuple[int | None, Turn, str]] = []
        state = {"conv": None, "seq": 0, "part": 0, "cut": True, "open": False, "type": None}

        def close(whole: bool) -> None:
            for column, value in zip(out, (state["conv"], state["part"], state["seq"], whole, *piece_of(held, whole)), strict=True):
                column.append(value)
            state["seq"] += 1
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            types = [state["type"], pa.int32(), pa.int64(), pa.bool_(), *_PIECE_TYPES]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
            for column in out:
                column.clear()

        for batch in batches:
            state["type"] = batch.schema.field("conv_id").type
            for conv, turn, initial, blank, truncated, n, later, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not state["open"]:
                    state.update(conv=conv, open=True, part=part)
                elif conv != state["conv"]:
                    close(whole=not state["cut"])
                    state.update(conv=conv, cut=False)
                for copy in range(n):
                    if len(held) >= PIECE:
                        close(whole=False)
                        state["cut"] = True
                    fault = "blank" if blank else "duplicate" if later or copy else "truncated" if truncated else ""
                    held.append((turn, Turn(initial, fault in ("blank", "duplicate"), truncated), fault))
                if len(out[0]) >= BATCH:
                    yield from flush()
        if state["open"]:
            close(whole=False)  # the next task may go on with it
            yield from flush()

    fields = f"conv_id {conv_type.simpleString()}, part int, seq long, whole boolean, {PIECE_FIELDS}"
    return ordered.mapInArrow(work, fields)


def _composed(pieces: DataFrame, scratch: Scratch, name: str = "pieces") -> DataFrame:
    """One piece a conversation: neighbours are joined ``FAN`` at a time until nothing is left to join."""
    conv_type = pieces.schema["conv_id"].dataType.simpleString()
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "seq")) - 1
    step = 0
    while True:
        parts = pieces.withColumn("at", rank).withColumn("group", F.floor(F.col("at") / FAN))

        def product(key: tuple, table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["at"])
            whole = Piece(*[rows[0][f] for f in _FACTS])
            for row in rows[1:]:
                whole = joined(whole, Piece(*[row[f] for f in _FACTS]))
            values = [rows[0]["conv_id"], 0, rows[0]["at"], True, *whole]
            names = ["conv_id", "part", "seq", "whole", *_FACTS]
            types = [table.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.bool_(), *_PIECE_TYPES]
            return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        fields = f"conv_id {conv_type}, part int, seq long, whole boolean, {PIECE_FIELDS}"
        pieces = scratch.save(parts.groupBy("conv_id", "group").applyInArrow(product, fields), f"{name}-{step}")
        step += 1
        most = pieces.groupBy("conv_id").count().agg(F.max("count")).first()[0]
        if (most or 0) <= 1:
            return pieces


def decide(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation that has rows."""
    pieces = scratch.save(_pieces(_narrow(rows)), "cut")
    single = pieces.where("whole")
    several = _composed(pieces.where("NOT whole"), scratch)
    found = single.unionByName(several)
    ends = [F.struct(F.col("costs")[e].alias("cost"), F.col("audits")[e].alias("audit")) for e in ENDS]
    ends = [F.when(F.col("costs")[e].isNotNull(), s) for e, s in zip(ENDS, ends, strict=True)]
    return found.withColumn("best", F.array_min(F.array_compact(F.array(*ends)))).select(
        "conv_id",
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).alias("gaps"),
        *[F.col(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.col("best.cost").alias("cost"),
        F.col("best.audit").alias("audit"),
    )


def _roles(audit: str) -> Iterator[str]:
    """The role of every turn that the audit leaves; only a kept row can be a system's, and only the first."""
    length = len(audit) - audit.count("D")
    if length % 2:
        yield ""
    for k in range(length - length % 2):
        yield NAMES["ua"[k % 2]]


class _Rebuild:
    """The turns of one conversation after its edits, hashed as they come or handed on."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.roles = audit, 0, _roles(audit)

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", next(self.roles), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            legal = next(self.roles)
            yield edit, role if edit == "K" else legal, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stream(rows: DataFrame, decided: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a conversation in order, behind a head row with its audit and counts."""
    heads = decided.withColumn("head", F.struct("audit", *COUNTS)).select("conv_id", "head")
    both = rows.where(~F.col("gone")).unionByName(heads, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("head").isNull(), *_order()
    )
    return both.select("conv_id", "head", *columns)


def repaired_turns(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of every turn of the repaired conversations."""
    rows = _with_digest(rows)
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    ship(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "place", "edit", "role", "text"]
        now, conv, place, kind = None, None, 0, None
        out: list[tuple] = []

        def take(turns: Iterable[tuple[str, str, str]]) -> None:
            nonlocal place
            for turn in turns:
                out.append((conv, place, *turn))
                place += 1

        def flush() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, head, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if head is not None:
                    if now:
                        take(now.end())
                    now, conv, place = _Rebuild(head["audit"]), conv_id, 0
                else:
                    take(now.row(role, text))
                if len(out) >= BATCH:
                    yield flush()
        if now:
            take(now.end())
            yield flush()

    stream = _stream(rows, decided, ["role", "text"])
    return stream.mapInArrow(work, f"conv_id {conv_type}, place long, edit string, role string, text string")


def _with_digest(rows: DataFrame) -> DataFrame:
    """Rows with a digest of role and text, by which equal ones are known and ties of a turn are ordered."""
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("digest", F.unhex(F.sha2(said.cast("binary"), 256)))


def repair(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` holds conv_id, turn, role, text and ``gone`` (a row that only says that its conversation exists);
    other columns are not looked at. Rows are taken by turn, null turns first; equal turns by role, then by a
    digest of role and text. A null conv_id is a conversation; null roles and texts must have been replaced. A
    role without a letter has no legal place. Repeated rows are duplicates. A conversation without rows has
    zeros, an empty audit and the hash of nothing; an empty table gives an empty one.
    """
    ship(rows.sparkSession)
    rows = _with_digest(rows.select("conv_id", "turn", "role", "text", "gone"))
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    decided = scratch.save(decide(rows, scratch), "decided")
    only_gone = rows.groupBy("conv_id").agg(F.bool_and("gone").alias("gone")).where("gone")
    nothing = only_gone.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("audit"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
        now, conv, kind, head, sha, first = None, None, None, None, None, True
        out: list[tuple] = []

        def take(turns: Iterable[tuple[str, str, str]]) -> None:
            nonlocal first
            for _, role, text in turns:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        def close() -> None:
            take(now.end())
            out.append((conv, *[head[c] for c in COUNTS], head["audit"], sha.hexdigest()))

        def flush() -> pa.RecordBatch:
            types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, top, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if top is not None:
                    if now:
                        close()
                    now, conv, head, sha, first = _Rebuild(top["audit"]), conv_id, top, hashlib.sha256(), True
                else:
                    take(now.row(role, text))
                if len(out) >= BATCH:
                    yield flush()
        if now:
            close()
            yield flush()

    counts = ", ".join(f"{c} long" for c in COUNTS)
    stream = _stream(rows, decided.unionByName(nothing), ["role", "text"])
    return stream.mapInArrow(work, f"conv_id {conv_type}, {counts}, audit string, repaired_sha256 string")
