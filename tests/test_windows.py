"""Windows and sequences against plain Python, with a customer that holds a third of all rows."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.operators.ordering import heavy_keys, with_position, with_running_totals
from strandline.operators.sequences import (
    customer_sequences,
    day_sequences,
    history,
    label_counts,
    label_customers,
    labelled_windows,
    month_sequences,
    week_sequences,
)

START = datetime.date(2023, 11, 20)
SCHEMA = "column1 long, column2 date, column3 string, event_id long, evnt string, label int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = []
    for i in range(3000):
        customer = 7 if i % 3 == 0 else rng.randrange(100, 160)
        if rng.random() < 0.02:
            customer = None
        day = START + datetime.timedelta(days=rng.choice([0, 1, 2, 5, 9, 30, 31, 40, 47, 48, 80]))
        text = None if rng.random() < 0.1 else f"e{rng.randrange(50)}"
        made.append((customer, day, rng.choice(["000000", "101500", "235959"]), i, text, rng.randrange(0, 8) if text and rng.random() < 0.2 else 0))
    rng.shuffle(made)
    return made


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def expected_windows(rows, only_positive=True):
    days = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2], r[3])):
        days[row[0], row[1]].append(row)
    result = {}
    for customer, day in days:
        x, y = [], [0] * 7
        for (other, d), events in sorted(days.items(), key=lambda item: item[0][1]):
            if other == customer and 0 <= (day - d).days <= 30:
                x += [e[4] for e in events if e[4] is not None]
            if other == customer and 1 <= (d - day).days <= 7:
                for e in events:
                    if e[5]:
                        y[e[5] - 1] = 1
        if any(y) or not only_positive:
            result[customer, day] = (" ".join(x), y)
    return result


def whole(df, *keys):
    """Parts joined up again."""
    parts = defaultdict(list)
    for row in df.collect():
        parts[tuple(row[k] for k in keys)].append(row)
    joined = {}
    for key, found in parts.items():
        found.sort(key=lambda r: r.part)
        assert [r.part for r in found] == list(range(len(found)))
        joined[key] = found
    return joined


@pytest.mark.parametrize("part_size", [50_000, 100, 7])
def test_windows_are_right_for_any_part_size(events, rows, part_size):
    want = expected_windows(rows)
    got = whole(labelled_windows(events, part_size=part_size), "column1", "column2")
    assert set(got) == set(want)
    for key, parts in got.items():
        assert " ".join(r.x for r in parts if r.x) == want[key][0]
        assert all(r.y == want[key][1] for r in parts)
    if part_size < 1000:
        assert max(len(r.x.split()) for parts in got.values() for r in parts) <= part_size


def test_history_keeps_days_without_labels(events, rows):
    want = expected_windows(rows, only_positive=False)
    got = whole(history(events, part_size=60), "column1", "column2")
    assert {k: " ".join(r.x for r in v if r.x) for k, v in got.items()} == {k: x for k, (x, _) in want.items()}


@pytest.mark.parametrize("partitions", ["1", "7", "64"])
def test_partitioning_does_not_show(spark, events, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = {tuple(r[:4]) for r in labelled_windows(events, part_size=100).collect()}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert {tuple(r[:4]) for r in labelled_windows(events.repartition(int(partitions)), part_size=100).collect()} == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("part_size", [50_000, 90, 4])
def test_day_and_customer_sequences(events, rows, part_size):
    ordered = sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2], r[3]))
    by_day, by_customer = defaultdict(list), defaultdict(list)
    for r in ordered:
        by_day[r[0], r[1]] += [r[4]] if r[4] else []
        by_customer[r[0],] += [r[4]] if r[4] else []
    days = whole(day_sequences(events, ("evnt", "label"), part_size=part_size), "column1", "column2")
    assert {k: [e for r in v for e in r.evnt] for k, v in days.items()} == dict(by_day)
    assert sum(len(r.label) for v in days.values() for r in v) == len(rows)
    customers = whole(customer_sequences(events, part_size=part_size), "column1")
    assert {k: [e for r in v for e in r.evnt] for k, v in customers.items()} == dict(by_customer)
    assert max(len(r.evnt) for v in customers.values() for r in v) <= part_size


@pytest.mark.parametrize("make", [week_sequences, month_sequences])
def test_periods_in_parts_join_up(events, make):
    keys = [c for c in make(events).columns if c not in ("part", "evnt")]
    whole_rows = {k: v[0].evnt for k, v in whole(make(events), *keys).items()}
    cut = whole(make(events, part_size=30, heavy=heavy_keys(events, "column1", 30)), *keys)
    assert {k: [e for r in v for e in r.evnt] for k, v in cut.items()} == whole_rows
    assert max(len(v) for v in cut.values()) > 1


def test_counts_by_label(spark, events, rows):
    want = {}
    for r in rows:
        if r[0] is not None:
            want.setdefault(r[5], []).append(r[0])
    assert {r.label: r.cnt for r in label_counts(events, "label").collect()} == {k: len(v) for k, v in want.items()}
    exact = {r.label: r.cnt for r in label_customers(events, "label").collect()}
    assert exact == {k: len(set(v)) for k, v in want.items()}
    rough = {r.label: r.cnt for r in label_customers(events, "label", approximate=True).collect()}
    assert all(abs(rough[k] - n) <= 0.15 * n + 1 for k, n in exact.items())


def test_frame_edges(spark):
    """7 and 30 days count, 8 and 31 do not; today is in the text and not in the flags."""
    day = datetime.date(2024, 3, 31)
    shifts = [(-31, 1), (-30, 2), (0, 3), (7, 4), (8, 5)]
    made = [(1, day + datetime.timedelta(days=s), "000000", i, f"d{s}", label) for i, (s, label) in enumerate(shifts)]
    row = labelled_windows(spark.createDataFrame(made, SCHEMA)).filter(F.col("column2") == day).first()
    assert (row.x, row.y) == ("d-30 d0", [0, 0, 0, 1, 0, 0, 0])


def test_frames_do_not_move_with_daylight_saving(spark):
    day = datetime.date(2024, 3, 28)
    made = [(1, day, "000000", 1, "a", 0), (1, day + datetime.timedelta(days=7), "000000", 2, "b", 2)]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert labelled_windows(spark.createDataFrame(made, SCHEMA)).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_complete_until_leaves_out_open_futures(spark):
    day = datetime.date(2024, 1, 1)
    made = [(1, day + datetime.timedelta(days=d), "000000", d, "a", 1) for d in range(10)]
    got = labelled_windows(spark.createDataFrame(made, SCHEMA), complete_until="2024-01-10")
    assert sorted(r.column2.day for r in got.collect()) == [1, 2, 3]


def test_weeks_split_at_month_ends_unless_iso(spark):
    made = [(1, datetime.date(2024, 12, 30), "0", 1, "a", 0), (1, datetime.date(2025, 1, 1), "0", 2, "b", 0)]
    df = spark.createDataFrame(made, SCHEMA)
    assert sorted(tuple(r)[1:4] for r in week_sequences(df).collect()) == [(2024, 12, 1), (2025, 1, 1)]
    assert [r.evnt for r in week_sequences(df, iso=True).collect()] == [["a", "b"]]


def test_positions_and_totals(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 50 END AS hot", "id % 7 AS v")
    got = with_position(df.repartition(13), F.col("hot").desc(), "id").collect()
    want = sorted(got, key=lambda r: (-r.hot, r.id))
    assert [r.position for r in want] == list(range(5000))
    total = 0
    for r in sorted(with_running_totals(df, F.col("id"), {"run": "v"}).collect(), key=lambda r: r.id):
        total += r.v
        assert r.run == total
