"""Physical plans: what they shuffle, scan and leave out."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from catalog import views
from strandline.operators.ordering import heavy_keys, with_position
from strandline.operators.sequences import customer_sequences, day_masks, future_labels
from strandline.plans.windows_job import window_dataset
from strandline.sources.shared import shared_folder
from strandline.sources.tables import load, save_table, scan_months

import __spark_entry__ as entry


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text


def test_flagship_has_one_shuffle_one_window_and_no_python(spark):
    text = plan(entry.entry(spark))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert len(re.findall(r"\bWindow \[", text)) == 1
    assert len(re.findall(r"FileScan", text)) == 1
    assert "Python" not in text and "rangepartitioning" not in text and "SinglePartition" not in text


def test_routes_scan_once_and_read_only_what_they_need(spark):
    text = plan(views.routed(spark, SF).select("column1", "evnt"))
    assert len(re.findall(r"FileScan", text)) == 1
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in text
    assert "PushedFilters: [In(event_type" in text


def test_masks_are_combined_before_the_shuffle(spark):
    text = plan(future_labels(day_masks(views.routed(spark, SF))))
    assert "partial_bit_or" in text and "Python" not in text


def test_months_prune_folders(spark):
    events = views.events(spark, SF).select("event_id", "part_yrmn")
    stored = save_table(events, shared_folder(spark, "events"), partition_by=("part_yrmn",))
    assert "PartitionFilters: [isnotnull(part_yrmn" in plan(scan_months(stored, "202401", "202402"))


def test_positions_move_only_counts_to_one_task(spark):
    text = plan(with_position(spark.range(1000).toDF("id"), "id"))
    single = text.split("SinglePartition")[1:]
    assert len(single) == 1 and "__n" in single[0].splitlines()[1]


@pytest.mark.parametrize("name", ["p6_route_events", "b1_label_events", "w2_history", "x2_split", "k3_mask_words", "e7_confusion"])
def test_row_functions_are_built_in(spark, name):
    assert not re.search("EvalPython|InPandas|InArrow", plan(entry.queries()[name](spark, SF)))


def test_heavy_customers_do_not_meet_in_one_task(spark):
    heavy = spark.range(4000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS column1", "DATE'2024-01-01' AS column2",
        "'000000' AS column3", "id AS event_id", "'a' AS evnt", "'x' AS column5",
    )
    rows = window_dataset(heavy.withColumn("col1", F.col("evnt")), {"x": views.Route.single("col1")}, [("a", 1, "contains")], only_positive=False, part_size=100)
    parts = rows.filter("column1 = -1").orderBy("part").collect()
    assert [r.part for r in parts] == list(range(14)) and sum(len(r.x.split()) for r in parts) == 1334
    assert rows.filter("column1 <> -1").count() == 4000 - 1334


def test_loading_reads_a_whole_table(spark):
    assert load(spark, SF, "nation").count() == 25


def test_next_events_are_counted_once(spark):
    """The bigram model is a stored table by the time its chains are joined."""
    text = plan(entry.queries()["r3_fill_next"](spark, SF))
    assert len(re.findall(r"FileScan parquet \[[^\]]*user_id", text)) == 1


def test_the_report_sorts_once(spark):
    text = plan(entry.queries()["evaluation_report"](spark, SF))
    assert text.count("rangepartitioning") == 0 and len(re.findall(r"FileScan", text)) == 1  # the sorted scores are stored


def test_given_heavy_keys_save_the_counting_pass(spark):
    routed = views.routed(spark, SF)
    heavy = heavy_keys(routed, "column1", 50_000)
    context = spark.sparkContext

    def jobs(**options):
        group = f"jobs-{bool(options)}"
        context.setJobGroup(group, group)
        customer_sequences(routed, **options)
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(group))

    assert jobs(heavy=heavy) < jobs()
