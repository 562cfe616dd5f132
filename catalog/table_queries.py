"""Scans, SQL texts, saved tables, batches."""

from pyspark.sql import functions as F

from catalog.registry import Catalog
from catalog.text_queries import documents
from catalog.views import hash_sql, words_sql
from strandline.operators.encoding import encode, pad_sequence
from strandline.operators.vocabulary import word_vocabulary
from strandline.sources.batches import make_batches, write_batches
from strandline.sources.shared import shared_folder
from strandline.sources.tables import (
    export_typed,
    load,
    load_encoded,
    run_sql,
    save_encoded,
    save_table,
    scan_months,
    scan_until,
)

CATALOG = Catalog()


def _orders(spark, sf):
    month = F.date_format("o_orderdate", "yyyyMM")
    return load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"), month.alias("part_yrmn")
    )


_ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS date) AS day,
  strftime(o_orderdate, '%Y%m') AS part_yrmn FROM orders"""


@CATALOG.add("s1_scan", "SELECT * FROM customer")
def scan(spark, sf):
    return load(spark, sf, "customer")


@CATALOG.add("s2_scan_months", f"SELECT * FROM ({_ORDERS_SQL}) WHERE part_yrmn BETWEEN '199612' AND '199803'")
def months(spark, sf):
    return scan_months(_orders(spark, sf), "199612", "199803")


@CATALOG.add("s3_scan_until", f"SELECT * FROM ({_ORDERS_SQL}) WHERE day <= DATE '1997-06-30'")
def until(spark, sf):
    return scan_until(_orders(spark, sf), "day", "1997-06-30")


@CATALOG.add(
    "s4_run_sql",
    """SELECT event_type, count(*) AS n FROM events GROUP BY event_type
       UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events""",
)
def sql_texts(spark, sf):
    by_type, users = run_sql(
        spark,
        [
            "SELECT event_type, count(*) AS n FROM source_events GROUP BY event_type",
            "SELECT 'users' AS event_type, count(DISTINCT user_id) AS n FROM source_events",
        ],
        views={"source_events": load(spark, sf, "events")},
    )
    return by_type.unionByName(users)


@CATALOG.add("s5_save_table", f"SELECT * FROM ({_ORDERS_SQL}) WHERE part_yrmn BETWEEN '199612' AND '199803'")
def saved(spark, sf):
    path = shared_folder(spark, "orders")
    stored = save_table(_orders(spark, sf), path, partition_by=("part_yrmn",))
    return scan_months(stored, "199612", "199803")


@CATALOG.add(
    "s6_save_partitions",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_custkey ELSE o_custkey END AS o_custkey,
              o_orderstatus FROM orders""",
)
def saved_partitions(spark, sf):
    path = shared_folder(spark, "orders")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    save_table(orders, path, partition_by=("o_orderstatus",))
    finished = orders.filter("o_orderstatus = 'F'").withColumn("o_custkey", -F.col("o_custkey"))
    return save_table(finished, path, partition_by=("o_orderstatus",), dynamic=True)


@CATALOG.add(
    "s7_encoded_rows",
    words_sql("""SELECT doc_id, '2,' || array_to_string(list_slice(ids, greatest(len(ids) - 253, 1), len(ids)), ',') || ',3'
                   || repeat(',1', greatest(254 - len(ids), 0)) AS input_ids,
                 CAST(least(len(ids), 254) + 2 AS int) AS used FROM ids"""),
)
def encoded_rows(spark, sf):
    docs = documents(spark, sf)
    rows = pad_sequence(encode(docs, word_vocabulary(docs, "text"), "text"))
    path = shared_folder(spark, "encoded")
    save_encoded(rows.drop("text"), path)
    return load_encoded(spark, path).select(
        "doc_id",
        F.array_join("input_ids", ",").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("used"),
    )


@CATALOG.add(
    "s8_export_typed",
    """SELECT CAST(l_orderkey AS int) AS l_orderkey, CAST(l_linenumber AS varchar) AS l_linenumber,
              CAST(l_extendedprice AS decimal(12, 2))::double::float AS price,
              CAST(l_quantity AS decimal(12, 0))::int AS quantity, CAST(l_discount AS float) AS l_discount FROM lineitem""",
)
def exported(spark, sf):
    lines = load(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.col("l_quantity").cast("decimal(12,0)").alias("quantity"),
        "l_discount",
    )
    return export_typed(
        lines,
        shared_folder(spark, "lines"),
        cast_dict={"l_linenumber": "string"},
        double_to_float=True,
        bigint_to_int=True,
    )


@CATALOG.add(
    "s9_batches",
    f"""SELECT doc_id, position, position // 32 AS batch_id
        FROM (SELECT doc_id, row_number() OVER (ORDER BY {hash_sql('42', 'doc_id')}, doc_id) - 1 AS position,
                     count(*) OVER () AS n FROM documents)
        WHERE position // 32 < n // 32""",
)
def batches(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id")
    return make_batches(docs, "doc_id", 32, drop_remainder=True)


@CATALOG.add(
    "s9_batches_in_order",
    """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position,
              (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM documents""",
)
def batches_in_order(spark, sf):
    return make_batches(load(spark, sf, "documents").select("doc_id"), "doc_id", 32, shuffle=False)


@CATALOG.add(
    "s9_batch_groups",
    f"""SELECT event_id, position, position // 128 AS batch_id, CAST(position // 128 // 4 AS int) AS batch_group
        FROM (SELECT event_id, row_number() OVER (ORDER BY {hash_sql('7', 'event_id')}, event_id) - 1 AS position FROM events)""",
)
def batch_groups(spark, sf):
    path = shared_folder(spark, "batches")
    write_batches(make_batches(load(spark, sf, "events").select("event_id"), "event_id", 128, seed=7), path, 4)
    return spark.read.parquet(path).withColumn("batch_group", F.col("batch_group").cast("int"))
