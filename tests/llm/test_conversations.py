"""Repair of conversations against every possible audit, in one task and in parts."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import conversation_repair as repair
from strandline.llm.role_parser import Automaton, Turn, all_tops, best_repair

ROLES = re.compile(r"(s?(ua)+)?")


def slowest_repair(turns, more=3):
    """The least (cost, audit) of all audits with a few insertions, and the roles it gives."""
    found = []
    for size in range(len(turns), len(turns) + more + 1):
        for audit in itertools.product("DIKR", repeat=size):
            if size - audit.count("I") != len(turns):
                continue
            cost, place, options = 0, 0, []
            for edit in audit:
                turn = turns[place] if edit != "I" else None
                place += edit != "I"
                if edit == "D":
                    cost += 4
                    continue
                if turn and turn.unusable:
                    break
                cost += (0 if edit == "K" else 3) + (3 if turn and turn.truncated else 0)
                options.append([turn.initial] if edit == "K" else ["u", "a"])
            else:
                roles = next((r for r in itertools.product(*options) if ROLES.fullmatch("".join(r))), None)
                if roles is not None:
                    found.append((cost, "".join(audit), roles))
    return min(found)


def test_cheapest_edits():
    draw, automaton = random.Random(2), Automaton()
    for _ in range(150):
        turns = [Turn(draw.choice("suauax "), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randrange(5))]
        assert best_repair(automaton, turns) == slowest_repair(turns)[:2]
    assert len(all_tops(automaton)) == 10


def test_a_grammar_with_two_readings():
    """Where a state has several actions for a symbol, all are followed."""
    grammar = (("x", ("left", "a")), ("x", ("right", "u")), ("left", ("u",)), ("right", ("u",)))
    automaton = Automaton(grammar)
    for roles, cost in (("ua", 0), ("uu", 0), ("aa", 3), ("u", 3), ("uaa", 4)):
        assert best_repair(automaton, [Turn(r) for r in roles])[0] == cost


TEXTS = ["Hello there.", "Why?", "cut off", " ", "", "Fine! \n", "Well.", "Yes", "\t\x0b", "a.b", None, "No "]


def rows_of(seed, conversations=40, most=5):
    draw = random.Random(seed)
    rows = []
    for conv_id in [None, *range(conversations)]:
        for _ in range(draw.randrange(most + 1)):
            turn = draw.choice([None, 0, 1, 2, 3, 5, 8])
            rows.append((conv_id, turn, draw.choice(["user", "assistant", "system", "user", "tool", None]), draw.choice(TEXTS), "x", 1))
    return rows + rows[:3]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, present int"


def expected(rows):
    """Reports by conversation, damage included."""
    whole = {}
    for conv_id, turn, role, text, *_ in rows:
        kept = whole.setdefault(conv_id, [])
        role, text = (" " if role is None else role), (" " if text is None else text)
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        draw = zlib.crc32(name.encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        row = (turn is not None, turn or 0, "user" if draw == 4 else role, text)
        kept += [] if draw == 0 else [row, row] if draw == 3 else [row]
    result = {}
    for conv_id, kept in whole.items():
        kept.sort()
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, _, role, text in kept:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            turns.append(Turn(role[:1], fault < 2, fault == 2))
        illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, roles = slowest_repair(turns, 2)
        edits, places, given = [e for e in audit if e != "D"], iter(kept), iter(roles)
        written = []
        for edit in audit:
            row = next(places) if edit != "I" else None
            if edit != "D":
                role = {"u": "user", "a": "assistant"}.get(r := next(given), r)
                written.append(f"{row[2] if edit == 'K' else role}:{'' if edit == 'I' else row[3]}")
        assert len(edits) == len(written)
        numbers = {t for known, t, *_ in kept if known}
        gap = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        digest = hashlib.sha256("\n".join(written).encode()).hexdigest()
        result[conv_id] = (gap, *counts, illegal, cost, audit, digest), written
    return result


@pytest.mark.parametrize("long", [repair.LONG, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_reports_and_turns(spark, seed, long):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    hurt = repair.damaged(df)
    want = expected(rows)
    got = {r.conv_id: tuple(r)[1:] for r in repair.reports(hurt, long).collect()}
    assert got == {conv_id: report for conv_id, (report, _) in want.items()}
    written = {}
    for r in repair.repaired(hurt, long).orderBy("conv_id", "place").collect():
        written.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert written == {conv_id: texts for conv_id, (_, texts) in want.items() if texts}


@pytest.mark.parametrize("long", [repair.LONG, 50])
def test_one_long_conversation(spark, long):
    """As cheap in many parts as in one; some turns stand in it twice, far apart."""
    draw = random.Random(5)
    turns = [(7, n, draw.choice(["user", "assistant"]), f"Turn {n % 700}.", None, None) for n in range(900)]
    df = spark.createDataFrame(turns + [(8, 0, "user", "Hi.", None, None)], SCHEMA)
    rows = repair.turns(df)
    whole = repair.Sequence([r[2] for r in turns], [r[3] for r in turns], repair.seen_before([r[2] for r in turns], [r[3] for r in turns]))
    got = {r.conv_id: r for r in repair.reports(rows, long).collect()}
    assert (got[7].cost, got[7].audit) == best_repair(Automaton(), whole.turns) and got[7].duplicate == whole.counts["duplicate"] > 0
    assert (got[7].illegal, got[7].gaps, got[8].audit, got[8].cost) == (whole.counts["illegal"], 0, "KI", 3)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.reports(repair.damaged(none)).count() == 0 and repair.repaired(repair.turns(none)).count() == 0
    gone = repair.turns(spark.createDataFrame([(1, 1, "user", "Hi.", "", 0)], SCHEMA)).withColumn("present", F.lit(False))
    report = repair.reports(gone).first()
    assert tuple(report) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
