"""Conversation repair: faults of turns, and the cheapest edits that make the roles follow their grammar.

Turns of a conversation are sorted in its task and read once by ``role_parser``. A turn's first fault counts: blank (no
character but white space), duplicate (role and text stood in an earlier turn), truncated (the last character but white
space is none of ``.!?``). Blank and duplicate turns are deleted; a truncated one costs extra where it stays.

Turns are ordered by number, nulls first, then by role and text. Null roles and texts are one space, so they can't be
kept as they are; null ``conv_id`` are one conversation, and repeated rows are turns of their own, which are duplicates.
A conversation without any turn has a report of zeros. Other columns are not read. An empty table gives an empty
result.

A conversation of over ``LONG`` turns, as a narrow count finds them, never meets in one task: its turns are sorted by
ranges that cut through conversations, earlier equals are found by salted groups, and every part of a conversation is
read from each possible stack, to a table of ten rows. Putting these in order gives the stack that each part really
starts from, and then the parts apply their edits. Only the final SHA-256 of a conversation reads its turns one after
the other, as it can't do otherwise, in a stream.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import WHITE_SPACE, with_group_totals
from strandline.llm.role_parser import Automaton, Turn, all_tops, apply, best, read
from strandline.operators.ordering import heavy_keys, split_heavy
from strandline.sources.shared import stored

LONG = 5_000
ROLES = {"u": "user", "a": "assistant"}
_ENDS = ".!?"
_BATCH = 2_000

_REPORT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)
_REPAIRED = "conv_id bigint, place bigint, turn bigint, role string, text string"
_LEGAL = {"su", "ua", "au"}


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) of all rows."""
    return conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(True).alias("present"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with faults, by the CRC-32 of conversation and turn: one in 20 is dropped, emptied, loses its ends of
    sentences, is repeated or given to the user. Dropped ones stay as rows that are not ``present``."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns(conversations).withColumn("__draw", (F.crc32(name.cast("binary")) % 20).cast("int"))
    draw = F.col("__draw")
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(draw == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (draw != 0).alias("present"),
        F.explode(F.sequence(F.lit(1), times)).alias("__copy"),
    ).drop("__copy")


def is_blank(text: str) -> bool:
    return not text.strip(WHITE_SPACE)


def is_truncated(text: str) -> bool:
    return text.rstrip(WHITE_SPACE)[-1:] not in tuple(_ENDS)


class Sequence:
    """Turns in a row, of a conversation or a part of it: their faults and what the parser needs to know."""

    def __init__(self, roles: list[str], texts: list[str], duplicates: list[bool]):
        blanks = list(map(is_blank, texts))
        again = [d and not b for d, b in zip(duplicates, blanks)]
        cut = [not b and not d and is_truncated(t) for t, b, d in zip(texts, blanks, again)]
        self.initials = [role[:1] for role in roles]
        self.turns = [Turn(i, b or d, c) for i, b, d, c in zip(self.initials, blanks, again, cut)]
        self.counts = {"blank": sum(blanks), "duplicate": sum(again), "truncated": sum(cut)}
        self.counts["illegal"] = sum(a + b not in _LEGAL for a, b in zip(self.initials, self.initials[1:]))


def seen_before(roles: list[str], texts: list[str]) -> list[bool]:
    seen: set[tuple[str, str]] = set()
    result = []
    for turn in zip(roles, texts):
        result.append(turn in seen)
        seen.add(turn)
    return result


def gaps(numbers: list[int | None]) -> int:
    known = {n for n in numbers if n is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[int | None], list[str], list[str]]]:
    """(conv_id, turns, roles, texts) of rows that come sorted; what is not present is left out."""
    current, rows = None, None
    for batch in batches:
        for conv_id, *row, present in zip(*[batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "present")]):
            if rows is None or conv_id != current:
                if rows is not None:
                    yield current, *map(list, zip(*rows) if rows else ([], [], []))
                current, rows = conv_id, []
            if present:
                rows.append(row)
    if rows is not None:
        yield current, *map(list, zip(*rows) if rows else ([], [], []))


def _repaired(automaton: Automaton, initials, numbers, roles, texts, audit, start=None):
    """(turn, role, text) of the repaired turns, and the last top; inserted ones have no turn."""
    edits, top = apply(automaton, start or automaton.bottom, initials, audit)
    rows = []
    for place, role in edits:
        if place < 0:
            rows.append((None, ROLES[role], ""))
        else:
            same = initials[place] == role
            rows.append((numbers[place], roles[place] if same else ROLES[role], texts[place]))
    return rows, top


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, schema)], schema=schema)


def _schema(ddl: str, **more: pa.DataType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    fields = [column.split() for column in ddl.split(", ")]
    return pa.schema([*[(name, kinds[kind]) for name, kind in fields], *more.items()])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton, out = Automaton(), []
    for conv_id, numbers, roles, texts in _conversations(batches):
        whole = Sequence(roles, texts, seen_before(roles, texts))
        cost, audit = best(automaton, read(automaton, {automaton.bottom: (0, "")}, whole.turns))
        rows, _ = _repaired(automaton, whole.initials, numbers, roles, texts, audit)
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in rows).encode()).hexdigest()
        out.append((conv_id, gaps(numbers), *whole.counts.values(), cost, audit, digest))
        if len(out) == _BATCH:
            yield _table(out, _REPORT)
            out = []
    yield _table(out, _REPORT)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for conv_id, numbers, roles, texts in _conversations(batches):
        whole = Sequence(roles, texts, seen_before(roles, texts))
        _, audit = best(automaton, read(automaton, {automaton.bottom: (0, "")}, whole.turns))
        rows, _ = _repaired(automaton, whole.initials, numbers, roles, texts, audit)
        yield _table([(conv_id, place, *row) for place, row in enumerate(rows)], _REPAIRED)


def _order() -> list[Column]:
    """Of the turns of a conversation. The row that only tells that there is a conversation goes anywhere."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _short_and_long(rows: DataFrame, long: int) -> tuple[DataFrame, DataFrame | None]:
    short, rest = split_heavy(rows, "conv_id", heavy_keys(rows, "conv_id", long))
    sorted_ = short.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *_order())
    return sorted_, rest


def reports(rows: DataFrame, long: int = LONG) -> DataFrame:
    """One row per conversation of ``turns`` or ``damaged``: its faults, the cost and letters of the edits, a digest."""
    short, rest = _short_and_long(rows, long)
    found = short.mapInArrow(_report, _REPORT)
    return found if rest is None else found.unionByName(_long_reports(*_long_repairs(rest)))


def repaired(rows: DataFrame, long: int = LONG) -> DataFrame:
    """(conv_id, place, turn, role, text): the repaired conversations, turns in the order of ``place``.

    Inserted turns have a null ``turn`` and an empty text.
    """
    short, rest = _short_and_long(rows, long)
    found = short.mapInArrow(_repair, _REPAIRED)
    return found if rest is None else found.unionByName(_long_repairs(rest)[2].select(found.columns))


# Long conversations

_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_PATHS = "array<struct<start: array<int>, top: array<int>, cost: bigint, audit: string>>"
_SUMMARY = f"name string, block bigint, conv_id bigint, {_COUNTS}, head string, tail string"
_CHOSEN = f"name string, block bigint, conv_id bigint, piece string, before bigint, {_COUNTS}, cost bigint, audit string"
_STATES = pa.list_(pa.int32())
_PATH = pa.struct([("start", _STATES), ("top", _STATES), ("cost", pa.int64()), ("audit", pa.string())])


def _parts(rows: DataFrame) -> DataFrame:
    """The turns in order, cut into blocks of a range partition each, and whether an equal one stood before."""
    named = rows.filter("present").drop("present").withColumn("name", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    named = stored(named.withColumn("digest", F.sha2("text", 256)), "long-conversations")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    totals = {"first": (F.min(place), F.min)}
    first = with_group_totals(named, ["name", "role", "digest"], ["turn"], totals)
    marked = first.withColumn("later", ~place.eqNullSafe(F.col("first"))).drop("first", "digest")
    order = [F.col("name"), *_order()]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("slot", F.monotonically_increasing_id()), "long-parts")


def _in_order(table: pa.Table) -> tuple[list, list, list, list[bool]]:
    """The columns of a part; of equal rows with one number, all but the first stood before."""
    table = table.sort_by("slot")
    numbers, roles, texts, later = (table[c].to_pylist() for c in ("turn", "role", "text", "later"))
    keys = list(zip(numbers, roles, texts))
    return numbers, roles, texts, [flag or (i > 0 and keys[i] == keys[i - 1]) for i, flag in enumerate(later)]


def _summarise(table: pa.Table) -> pa.Table:
    automaton = Automaton()
    _, roles, texts, again = _in_order(table)
    part = Sequence(roles, texts, again)
    paths = [
        {"start": list(start.states()), "top": list(top.states()), "cost": cost, "audit": audit}
        for start in all_tops(automaton)
        for top, (cost, audit) in read(automaton, {start: (0, "")}, part.turns).items()
    ]
    row = {"name": table["name"][0].as_py(), "block": table["block"][0].as_py(), "conv_id": table["conv_id"][0].as_py()}
    row |= part.counts | {"head": part.initials[0], "tail": part.initials[-1], "paths": paths}
    return pa.Table.from_pylist([row], _schema(_SUMMARY, paths=pa.list_(_PATH)))


def _choose(table: pa.Table) -> pa.Table:
    """The parts of one conversation put together; a row for each part with its piece of the audit."""
    automaton = Automaton()
    parts = table.sort_by("block").to_pylist()
    tops, back = {automaton.bottom.states(): (0, "")}, []
    for part in parts:
        new, came = {}, {}
        for path in part["paths"]:
            start, top = tuple(path["start"]), tuple(path["top"])
            if start in tops:
                cost, audit = tops[start]
                value = cost + path["cost"], audit + path["audit"]
                if top not in new or value < new[top]:
                    new[top], came[top] = value, (start, path["audit"])
        tops = new
        back.append(came)
    (cost, audit), top = min(
        (best(automaton, {stack: value}), stack.states())
        for stack, value in ((automaton.stack(states), value) for states, value in tops.items())
    )
    rest = audit[len(tops[top][1]) :]  # what is inserted at the end
    rows, before = [], 0
    for part, came in zip(reversed(parts), reversed(back)):
        start, piece = came[top]
        rows.append({"name": part["name"], "block": part["block"], "conv_id": part["conv_id"], "start": start, "piece": piece + rest})
        top, rest = start, ""
    rows.reverse()
    counts = {c: sum(part[c] for part in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    counts["illegal"] += sum(a["tail"] + b["head"] not in _LEGAL for a, b in zip(parts, parts[1:]))
    for i, row in enumerate(rows):
        row |= {"before": before} | (counts | {"cost": cost, "audit": audit} if i == 0 else {})
        before += len(row["piece"].replace("D", ""))
    return pa.Table.from_pylist(rows, _schema(_CHOSEN, start=_STATES))


def _apply_pieces(parts: pa.Table, chosen: pa.Table) -> pa.Table:
    automaton = Automaton()
    numbers, roles, texts, _ = _in_order(parts)
    row = chosen.to_pylist()[0]
    start = automaton.stack(row["start"])
    rows, _ = _repaired(automaton, [r[:1] for r in roles], numbers, roles, texts, row["piece"], start)
    return pa.Table.from_batches([_table([(row["conv_id"], row["before"] + i, *r) for i, r in enumerate(rows)], _REPAIRED)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation, whose turns come in order, as a stream."""
    out, current, digest = [], None, None
    for batch in batches:
        for conv_id, role, text in zip(*[batch[c].to_pylist() for c in ("conv_id", "role", "text")]):
            if digest is None or conv_id != current:
                if digest is not None:
                    out.append((current, digest.hexdigest()))
                current, digest, glue = conv_id, hashlib.sha256(), ""
            digest.update(f"{glue}{role}:{text}".encode())
            glue = "\n"
    if digest is not None:
        out.append((current, digest.hexdigest()))
    yield _table(out, "conv_id bigint, repaired_sha256 string")


def _long_repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, chosen edits, repaired turns) of long conversations."""
    parts = _parts(rows).withColumn("block", F.shiftright("slot", 33))
    keys = ["name", "block"]
    summaries = stored(parts.groupBy(*keys).applyInArrow(_summarise, f"{_SUMMARY}, paths {_PATHS}"), "long-summaries")
    chosen = stored(summaries.groupBy("name").applyInArrow(_choose, f"{_CHOSEN}, start array<int>"), "long-edits")
    edits = parts.groupBy(*keys).cogroup(chosen.groupBy(*keys))
    return rows, chosen, stored(edits.applyInArrow(_apply_pieces, _REPAIRED), "long-repaired")


def _long_reports(rows: DataFrame, chosen: DataFrame, turns_: DataFrame) -> DataFrame:
    numbers = rows.groupBy("conv_id").agg(
        F.coalesce(
            F.max(F.when(F.col("present"), F.col("turn"))) - F.min(F.when(F.col("present"), F.col("turn"))) + 1
            - F.countDistinct(F.when(F.col("present"), F.col("turn"))), F.lit(0)
        ).alias("gaps")
    )
    digests = turns_.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    digests = digests.mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")
    found = chosen.filter("cost is not null")
    counts = [F.coalesce(found[c], F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    report = numbers.join(found, numbers["conv_id"].eqNullSafe(found["conv_id"]), "left").join(
        digests, numbers["conv_id"].eqNullSafe(digests["conv_id"]), "left"
    )
    return report.select(
        numbers["conv_id"], "gaps", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
