import hashlib
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.operators.events import (
    Route,
    cast_columns,
    default_time,
    join_codes,
    join_current,
    route_events,
    select_regex,
)
from strandline.operators.features import bucket_ids, check_ids, join_features, shift_ids
from strandline.operators.labels import flags, label_bit, label_events, label_sum, multi_hot
from strandline.operators.ordering import union_all
from strandline.operators import sampling
from strandline.operators.sampling import split, split_exact, stratified_sample
from strandline.sources.tables import scan_until


def texts(df, *cols):
    return [tuple(r) for r in df.orderBy("id").select(*cols).collect()]


def test_null_time_becomes_midnight(spark):
    df = spark.createDataFrame([(1, None), (2, "120000")], "id int, column3 string")
    assert texts(default_time(df), "column3") == [("000000",), ("120000",)]


def test_conditional_route_is_null_where_channel_or_text_is_unknown(spark):
    rows = [(1, 2000, "a", "b"), (2, 1111, "a", "b"), (3, 1111, "a", "-"), (4, 1111, "a", None), (5, None, "a", "-"), (6, 2000, "a", None)]
    df = spark.createDataFrame(rows, "id int, column4 int, c0 string, c1 string").withColumn("column5", F.lit("x"))
    got = texts(route_events(df, {"x": Route.conditional("c0", "c1")}), "evnt")
    assert got == [("a",), ("b",), ("a",), (None,), (None,), ("a",)]


def test_pair_route_is_null_if_either_is_and_unknown_codes_go(spark):
    df = spark.createDataFrame(
        [(1, "x", "a", "b"), (2, "x", None, "b"), (3, "x", "a", None), (4, "other", "a", "b")],
        "id int, column5 string, c0 string, c1 string",
    )
    got = texts(route_events(df, {"x": Route.pair("c0", "c1")}), "id", "evnt")
    assert got == [(1, "a_b"), (2, None), (3, None)]


def test_first_rule_wins_and_null_is_class_zero(spark):
    rules = [("m4", 4, "equals"), ("m1", 1, "contains"), ("m4", 4, "contains"), ("m5", 5, "contains")]
    df = spark.createDataFrame([(1, "xm5m1"), (2, "m4"), (3, "m44"), (4, "m5"), (5, None), (6, "")], "id int, evnt string")
    assert [r[0] for r in texts(label_events(df, rules), "label")] == [1, 4, 4, 5, 0, 0]


def test_flags_and_their_sum(spark):
    df = spark.createDataFrame([(1, [0, 1, 7, 7]), (2, [0]), (3, [2])], "id int, labels array<int>")
    masks = df.select("id", F.explode("labels").alias("l")).groupBy("id").agg(F.bit_or(label_bit(F.col("l"))).alias("mask"))
    got = texts(label_sum(multi_hot(masks)), "y", "sum")
    assert got == [([1, 0, 0, 0, 0, 0, 1], 2), ([0] * 7, 0), ([0, 1, 0, 0, 0, 0, 0], 1)]


def test_labels_beyond_the_classes_fail(spark):
    df = spark.createDataFrame([(8,)], "label int").select(label_bit(F.col("label")).alias("mask"))
    with pytest.raises(Exception, match="beyond the 7 classes"):
        multi_hot(df).collect()
    with pytest.raises(Exception, match="no bit for class 64"):
        spark.createDataFrame([(64,)], "label int").select(label_bit(F.col("label"))).collect()


def test_features_need_one_row_per_customer(spark):
    seq = spark.createDataFrame([(1,)], "column1 int")
    same = spark.createDataFrame([(1, 5), (1, 5)], "column1 int, f int")
    assert [tuple(r) for r in join_features(seq, same, "column1").collect()] == [(1, 5)]
    with pytest.raises(Exception, match="two rows for dimension key"):
        join_features(seq, same.union(spark.createDataFrame([(1, 6)], same.schema)), "column1").collect()


def test_cast_priority(spark):
    df = spark.sql("SELECT 1L AS big, 2.5D AS dbl, 3.25BD AS dec, 4BD AS whole, 'x' AS `odd name`, 5 AS int")
    assert dict(cast_columns(df).dtypes) == {
        "big": "bigint", "dbl": "double", "dec": "double", "whole": "bigint", "odd name": "string", "int": "int",
    }
    narrow = cast_columns(df, {"dec": "string"}, double_to_float=True, bigint_to_int=True)
    assert [t for _, t in narrow.dtypes] == ["int", "float", "string", "int", "string", "int"]
    floats = cast_columns(df, numeric_to_float=True)
    assert [t for _, t in floats.dtypes] == ["float", "float", "float", "float", "string", "float"]
    with pytest.raises(ValueError):
        cast_columns(df, {"big": "biging"})


def test_select_by_regex(spark):
    df = spark.sql("SELECT 1 AS cust_id1, 2 AS cust_id2, 3 AS other_cust_id1")
    assert select_regex(df, "cust_id[0-9]+").columns == ["cust_id1", "cust_id2"]


def test_joins_keep_rows_and_refuse_two_different_rows_of_a_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    dim = spark.createDataFrame([("a", "9999-12-31", "new"), ("a", "2020-01-01", "old"), ("b", "2020-01-01", "old")], "key string, end string, v string")
    assert texts(join_current(df, dim, "k", "key", "end", columns=("v",)), "id", "v") == [(1, "new"), (2, None), (3, None)]
    twice = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "key string, v string")
    assert texts(join_codes(df, twice, "k", "key", ("v",)), "id", "v") == [(1, "x"), (2, None), (3, None)]
    with pytest.raises(PySparkException, match="two rows for dimension key"):
        join_codes(df, spark.createDataFrame([("a", "x"), ("a", "y")], "key string, v string"), "k", "key", ("v",)).collect()


def test_features(spark):
    df = spark.createDataFrame([(1, 0, None, 7), (2, 3, 1, None)], "id int, f long, g long, label int")
    assert texts(shift_ids(df, ["id", "label"]), "f", "g", "label") == [(1, 0, 7), (4, 2, None)]
    report = check_ids(shift_ids(df, ["id", "label"]), {"f": 4, "g": 5}).orderBy("feature").collect()
    assert [tuple(r) for r in report] == [("f", 1, 4, 0.0, 1), ("g", 0, 2, 0.5, 0)]
    known = spark.createDataFrame([(2, 9)], "id int, z int")
    assert texts(join_features(df, known, "id"), "z") == [(0,), (9,)]
    amounts = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 99.0), (4, None)], "id int, v double")
    assert [r[0] for r in texts(bucket_ids(amounts, "v", [10, 20], "b"), "b")] == [1, 2, 3, 0]


def test_union_goes_by_name(spark):
    a, b = spark.sql("SELECT 1 AS x, 'p' AS y"), spark.sql("SELECT 'q' AS y, 2 AS x")
    assert sorted(map(tuple, union_all(a, b, a).collect())) == [(1, "p"), (1, "p"), (2, "q")]


def test_invalid_end_date_is_refused(spark):
    with pytest.raises(ValueError):
        scan_until(spark.sql("SELECT DATE'2023-01-01' AS date"), "date", "2023-00-00")


def test_split_keeps_customers_together_and_does_not_depend_on_partitions(spark):
    df = spark.range(20_000).withColumn("customer", F.col("id") % 3000)
    parts = split(df, "customer")
    shares = {r.split: r.n for r in parts.groupBy("split").agg(F.count_distinct("customer").alias("n")).collect()}
    assert sum(shares.values()) == 3000
    assert abs(shares["test"] / 3000 - 0.2) < 0.03 and abs(shares["valid"] / 3000 - 0.08) < 0.02
    assert split(df.repartition(37), "customer").exceptAll(parts).isEmpty()


def test_stratified_sample_drops_unlisted_classes(spark):
    df = spark.range(10_000).selectExpr("id", "CASE WHEN id % 4 < 3 THEN id % 4 END AS label")
    got = {r.label: r.n for r in stratified_sample(df, "label", {0: 0.1, 1: 1.0}, "id").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {0, 1} and got[1] == 2500 and abs(got[0] / 2500 - 0.1) < 0.03


@pytest.mark.parametrize("few", [1, 4_096])
def test_exact_split_sizes(spark, monkeypatch, few):
    """ceil of the share of the keys, then of those that are left; null is a key, and any partitioning gives the same."""
    monkeypatch.setattr(sampling, "FEW", few)
    for n in (1, 2, 5, 999, 3_000):
        df = spark.range(4 * n).select(F.when(F.col("id") % n > 0, F.col("id") % n).alias("customer"), "id")
        parts = split_exact(df, "customer")
        sizes = {r.split: r.n for r in parts.select("customer", "split").distinct().groupBy("split").agg(F.count("*").alias("n")).collect()}
        test = math.ceil(0.2 * n)
        valid = math.ceil(0.1 * (n - test))
        assert sizes == {k: v for k, v in {"test": test, "valid": valid, "train": n - test - valid}.items() if v}
        assert n < 999 or split_exact(df.repartition(13), "customer").exceptAll(parts).isEmpty()
    assert split_exact(df.limit(0), "customer").count() == 0


def test_exact_split_takes_the_smallest_hashes(spark):
    rows = split_exact(spark.range(500), "id", test=0.3, valid=0.5, seed=7).collect()
    order = sorted(range(500), key=lambda i: hashlib.md5(f"7:test:{i}".encode()).hexdigest())
    assert {r.id for r in rows if r.split == "test"} == set(order[:150])
    rest = sorted(order[150:], key=lambda i: hashlib.md5(f"7:valid:{i}".encode()).hexdigest())
    assert {r.id for r in rows if r.split == "valid"} == set(rest[:175])
