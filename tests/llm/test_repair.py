"""Conversation repair against a plain search over edits, on random and awkward turns and on the whole small table."""

import random
import re
import zlib

import numpy as np
import pytest

from folioscope.llm import queries, repair

from .brute import sha

NEXT = {"-": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """(cost, edits, lines): whole strings of edits compared, messages put in until nothing gets cheaper."""
    after = None
    for at in range(len(turns), -1, -1):
        now = {}
        for state in "-sua":
            found = [(0, "", ())] if at == len(turns) and state in "-a" else []
            if at < len(turns):
                role, text, gone, cut = turns[at]
                cost, edits, lines = after[state]
                found.append((3 + cost, "D" + edits, lines))
                nxt = NEXT[state]
                kept = "s" if state == "-" and role[:1] == "s" else nxt if role[:1] == nxt else None
                if not gone and kept:
                    cost, edits, lines = after[kept]
                    found.append((cut + cost, "K" + edits, (f"{role}:{text}", *lines)))
                if not gone:
                    cost, edits, lines = after[nxt]
                    found.append((2 + cut + cost, "R" + edits, (f"{NAMES[nxt]}:{text}", *lines)))
            now[state] = min(found, key=lambda x: x[:2]) if found else (10**9, "", ())
        for _ in range(5):
            for state in "-sua":
                cost, edits, lines = now[NEXT[state]]
                now[state] = min(now[state], (2 + cost, "I" + edits, (f"{NAMES[NEXT[state]]}:", *lines)), key=lambda x: x[:2])
        after = now
    return after["-"]


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        yield from [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def mended(rows, ids):
    """Rows of the contract for conversations as they are, for each of ``ids``."""
    out = []
    for conv in ids:
        mine = sorted(((t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        numbers, seen, turns, n = {t for t, _, _ in mine if t is not None}, set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, edits, lines = cheapest(turns)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *n.values(), illegal, cost, edits, sha("\n".join(lines))))
    return out


def rows(frame):
    assert frame.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def same(found, wanted):
    assert found == sorted(wanted, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def talk(seed, conversations, longest):
    dice = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "so it goes", "", " \t", "Yes.  ", "Yes.\n", "…", "x" * 70 + "a.", "x" * 70 + "b."]
    return [(conv, dice.choice([t, t, t, None, 3]), dice.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), dice.choice([*texts, None])) for conv in [None, *range(conversations)] for t in range(dice.randint(1, longest))]


@pytest.mark.parametrize("piece", [2, repair.PIECE_TURNS])
def test_random_turns(spark, piece):
    table = talk(piece, 60, 14)
    ids = {r[0] for r in table}
    frame = spark.createDataFrame(table, SCHEMA).repartition(3).selectExpr("'x' AS cost", "*", "1 AS piece", "'y' AS `odd.name`")
    same(rows(repair.repair(frame, piece)), mended(table, ids))


def test_long_conversation_over_tasks_and_pieces(spark):
    table = [(1, t, ["user", "assistant", "tool"][t % 7 % 3], f"turn {t % 90}" + "." * (t % 2)) for t in range(700)] + [(2, None, "user", "again.")] * 300 + [(3, 5, "system", "Be kind.")]
    same(rows(repair.repair(spark.createDataFrame(table, SCHEMA).repartition(4), 16)), mended(table, [1, 2, 3]))


def test_damage_and_conversations_without_turns(spark):
    table = talk(3, 150, 4)
    found = rows(repair.repair_damaged(spark.createDataFrame(table, SCHEMA)))
    same(found, mended(list(damaged(table)), {r[0] for r in table}))
    assert any(r[7] == "" and r[8] == sha("") for r in found)


def test_whole_table(spark):
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(rows(queries.op13_conversation_repair(spark, "/root/testdata/sf0.001")), mended(list(damaged(table)), {r[0] for r in table}))


def test_empty_table(spark):
    assert rows(repair.repair_damaged(spark.createDataFrame([], SCHEMA))) == []


def test_unlike_lengths_share_no_bucket():
    turn = {"role": "user", "text": "a.", "code": 1, "initial": "u"}
    found = repair.Turns([[turn] * n for n in (1, 2, 3, 40, 7, 1)])
    held = [sorted(lengths.tolist()) for _, _, lengths in found.buckets()]
    assert sorted(sum(held, [])) == [1, 1, 2, 3, 7, 40] and all(x[-1] <= 2 * x[0] for x in held)
    assert all(codes.shape[0] == lengths.max() for _, codes, lengths in found.buckets()) and np.all(found.counts["duplicate"] == [0, 1, 2, 39, 6, 0])
