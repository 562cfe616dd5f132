import pytest
from conftest import SF
from pyspark.sql import functions as F

from strandline.sources.batches import make_batches, write_batches
from strandline.sources.shared import shared_folder
from strandline.sources.tables import export_typed, load, run_sql, save_encoded, save_table, spread


def test_round_trip_keeps_types(spark):
    df = spark.sql("SELECT 1 AS a, '202201' AS part_yrmn UNION ALL SELECT 2, '202202'")
    stored = save_table(df, shared_folder(spark, "t"), partition_by=("part_yrmn",))
    assert dict(stored.dtypes) == dict(df.dtypes)
    assert sorted(map(tuple, stored.collect())) == [(1, "202201"), (2, "202202")]


def test_dynamic_overwrite_leaves_other_partitions(spark):
    path = shared_folder(spark, "t")
    save_table(spark.sql("SELECT 1 AS a, 'x' AS p UNION ALL SELECT 2, 'y'"), path, partition_by=("p",))
    stored = save_table(spark.sql("SELECT 9 AS a, 'y' AS p"), path, partition_by=("p",), dynamic=True)
    assert sorted(map(tuple, stored.collect())) == [(1, "x"), (9, "y")]


def test_named_tables(spark):
    first = spark.sql("SELECT 'x' AS p, 1 AS a UNION ALL SELECT 'y', 2")
    assert sorted(map(tuple, save_table(first, "named", "overwrite", ("p",)).select("p", "a").collect())) == [("x", 1), ("y", 2)]
    second = save_table(spark.sql("SELECT 'y' AS p, 9 AS a"), "named", partition_by=("p",), dynamic=True)
    assert sorted(map(tuple, second.select("p", "a").collect())) == [("x", 1), ("y", 9)]
    assert load(spark, None, "named").count() == 2


def test_saving_over_a_table_needs_a_word(spark):
    path = shared_folder(spark, "t")
    save_table(spark.range(1).toDF("a"), path)
    with pytest.raises(Exception, match="(?i)exists"):
        save_table(spark.range(1).toDF("a"), path)


def test_sql_lists(spark):
    one = run_sql(spark, "SELECT count(*) AS n FROM v", {"v": spark.range(3)})
    assert one.first().n == 3
    assert [d.first()[0] for d in run_sql(spark, ["SELECT 1", "SELECT 2"])] == [1, 2]
    wide = {"v": spark.sql("SELECT 1 AS cust_1, 2 AS cust_2, 3 AS other")}
    assert run_sql(spark, "SELECT `cust_.*` FROM v", wide, use_regex=True).columns == ["cust_1", "cust_2"]
    assert spark.conf.get("spark.sql.parser.quotedRegexColumnNames") == "false"


def test_export_casts(spark):
    got = export_typed(spark.sql("SELECT 1.50BD AS a, 7L AS b"), shared_folder(spark, "t"), double_to_float=True)
    assert got.dtypes == [("a", "float"), ("b", "bigint")]


def test_encoded_rows_need_their_columns(spark):
    with pytest.raises(ValueError):
        save_encoded(spark.range(1), shared_folder(spark, "t"))


@pytest.mark.parametrize("shuffle", [True, False])
def test_batches(spark, shuffle):
    df = spark.range(1000).repartition(5)
    got = make_batches(df, "id", 64, shuffle=shuffle).collect()
    assert sorted(r.position for r in got) == list(range(1000))
    assert all(r.batch_id == r.position // 64 for r in got)
    assert ([r.id for r in sorted(got, key=lambda r: r.position)] == list(range(1000))) is not shuffle
    full = make_batches(df, "id", 64, shuffle=shuffle, drop_remainder=True)
    assert full.count() == 1000 // 64 * 64


def test_batch_files(spark):
    path = shared_folder(spark, "t")
    write_batches(make_batches(spark.range(100), "id", 10), path, 2)
    stored = spark.read.parquet(path)
    assert stored.count() == 100 and stored.select("batch_group").distinct().count() == 5
    files = stored.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()
    assert [r.n for r in files] == [20] * 5


def test_spread_leaves_big_scans_alone(spark):
    small = spark.read.parquet(f"{SF}/documents.parquet")
    assert spread(small).rdd.getNumPartitions() == 8
    wide = spark.range(0, 100, numPartitions=20)
    assert spread(wide) is wide
