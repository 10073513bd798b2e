"""Conversation repair against a plain search of all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from pageloom.llm import conversations
from pageloom.llm.conversations import Turn
from pageloom.llm.queries import QUERIES
from pageloom.llm.storage import Scratch

SF = "/root/testdata/sf0.01"
WORDY = re.compile(r"[^\x20\x09-\x0D]")
STEPS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NUMBERS = ["", "s", "u", "a"]


def plainly_cheapest(turns, start="", ends=("", "a")):
    """All edits tried, from the last row back."""

    @lru_cache(None)
    def rest(i, state, inserts):
        found = [(0, "")] if i == len(turns) and state in ends else []

        def then(price, letter, tail):
            if tail is not None:
                found.append((price + tail[0], letter + tail[1]))

        for initial in "ua":
            if inserts and initial in STEPS[state]:
                then(3, "I", rest(i, STEPS[state][initial], inserts - 1))
        if i < len(turns):
            role, banned, truncated = turns[i]
            then(4, "D", rest(i + 1, state, inserts))
            for initial, after in STEPS[state].items():
                if banned:
                    continue
                if initial == role:
                    then(3 * truncated, "K", rest(i + 1, after, inserts))
                elif initial != "s":
                    then(3 + 3 * truncated, "R", rest(i + 1, after, inserts))
        return min(found, default=None)

    return rest(0, start, len(turns) + 3)


def plainly_repaired(rows):
    """What the query gives, from (conv_id, turn, role, text) rows."""
    kept = {}
    for conv, turn, role, text in rows:
        mine = kept.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        code = zlib.crc32(key.encode()) % 20
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        if code:
            mine.extend([(turn, role, text)] * (2 if code == 3 else 1))
    out = {}
    for conv, mine in kept.items():
        digest = {m: hashlib.sha256(f"{len(m[1])}:{m[1]}{m[2]}".encode()).digest() for m in mine}
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), digest[m]))
        numbers = [m[0] for m in mine if m[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults, seen, turns = [], set(), []
        for _, role, text in mine:
            said = WORDY.findall(text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else ""
            seen.add((role, text))
            cut = bool(said) and said[-1] not in ".!?"
            faults.append(fault or ("truncated" if cut else ""))
            turns.append(Turn(role[:1], fault != "", cut))
        illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit = plainly_cheapest(tuple(turns))
        left, length, at = [], len(audit) - audit.count("D"), 0
        legal = ("s" if length % 2 else "") + "ua" * (length // 2)
        for edit in audit:
            if edit == "I":
                left.append({"u": "user", "a": "assistant"}[legal[len(left)]] + ":")
                continue
            _, role, text = mine[at]
            at += 1
            if edit != "D":
                role = role if edit == "K" else {"u": "user", "a": "assistant"}[legal[len(left)]]
                left.append(f"{role}:{text}")
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ROWS = "conv_id long, turn long, role string, text string"


def repaired(spark, rows, extra=False):
    frame = spark.createDataFrame(rows, ROWS)
    if extra:
        frame = frame.withColumns({"gone": F.lit("x"), "digest": F.lit(1), "head": F.lit(2)})
    got = conversations.repair(conversations.damage(frame), Scratch(spark, "t")).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


def random_turns(rng, n):
    return tuple(Turn(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n))


def test_search_from_both_ends_against_all_edits():
    rng = random.Random(1)
    for _ in range(300):
        turns = random_turns(rng, rng.randrange(8))
        for a, start in enumerate(NUMBERS):
            for b, end in enumerate(NUMBERS):
                assert conversations.cheapest(list(turns), a, (b,)) == plainly_cheapest(turns, start, (end,))
        assert conversations.cheapest(list(turns)) == plainly_cheapest(turns)


def test_joined_pieces_equal_one_piece():
    rng = random.Random(2)
    for _ in range(200):
        numbers = sorted(rng.choice([-1, 1, 2, 3]) for _ in range(rng.randrange(1, 9)))
        rows = [(None if k < 0 else k, t, "") for k, t in zip(numbers, random_turns(rng, len(numbers)), strict=True)]
        cut = rng.randrange(len(rows) + 1)
        halves = [conversations.piece_of(part, False) for part in (rows[:cut], rows[cut:])]
        assert conversations.joined(*halves) == conversations.piece_of(rows, False)


def test_query_against_plain_search(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_conversation_repair"](spark, SF).collect()}
    assert got == plainly_repaired(rows)


def test_odd_conversations(spark):
    """Nulls in every column, ties, repeated rows, roles without a place, texts without words, a lost one."""
    dropped = next(k for k in range(1000, 9999) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows = [
        (None, None, None, None),
        (None, 3, "user", "a b."),
        (1, None, "user", "Hello."),
        (1, 2, "assistant", None),
        (1, 2, "", "no role."),
        (1, 2, "assistant", "Yes!  \t"),
        (1, 2, "assistant", "Yes!  \t"),
        (1, 9, "tool", "é漢字🙂."),
        (2, 5, "assistant", "only an answer"),
        (2, 7, "assistant", "and\none more?"),
        (3, 1, "system", " \x0b\n"),
        (dropped, 1, "user", "gone."),
        (4, 1, "system", "s" * 200_000),
    ]
    got = repaired(spark, rows, extra=True)
    assert got == plainly_repaired(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(spark, []) == {}


@pytest.mark.parametrize("piece", [3, 64])
def test_long_conversations_are_cut_into_pieces(spark, monkeypatch, piece):
    """A conversation of many pieces, over several tasks, with texts that come back much later."""
    monkeypatch.setattr(conversations, "PIECE", piece)
    monkeypatch.setattr(conversations, "FAN", 3)
    rng = random.Random(3)
    rows = [(k % 3 // 2, k, rng.choice(["user", "assistant", "system"]), f"t{rng.randrange(400)}{rng.choice('. ')}") for k in range(600)]
    rows += [(7, 1, "user", f"x{k % 5}.") for k in range(50)]
    assert repaired(spark, rows) == plainly_repaired(rows)


def test_repaired_turns_are_legal(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet")
    rows, scratch = conversations.damage(frame), Scratch(spark, "t")
    decided = conversations.decide(conversations._with_digest(rows), scratch)
    turns = conversations.repaired_turns(rows, decided).collect()
    roles = {}
    for t in sorted(turns, key=lambda t: (t.conv_id, t.place)):
        roles.setdefault(t.conv_id, []).append(t.role[0])
    assert roles and all(re.fullmatch("s?(ua)+", "".join(r)) for r in roles.values())
    assert all(t.text == "" for t in turns if t.edit == "I")
