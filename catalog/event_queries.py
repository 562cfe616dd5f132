"""Event rows: defaults, routes, casts, joins, order, labels, features, samples."""

from pyspark.sql import functions as F

from catalog.registry import Catalog
from catalog.views import (
    DIMENSION_SQL,
    EVENTS_SQL,
    FEATURES_SQL,
    ROUTES,
    RULES,
    dimension,
    draw_sql,
    events,
    events_sql,
    features,
    flags_sql,
    routed,
)
from strandline.operators.events import (
    cast_columns,
    default_time,
    join_codes,
    join_current,
    rename,
    route_events,
    select_regex,
)
from strandline.operators.features import bucket_ids, check_ids, join_features, shift_ids
from strandline.operators.labels import keep_positive, label_events, label_sum, label_vector, multi_hot
from strandline.operators.ordering import order_output, preview, union_all
from strandline.operators.sampling import split, split_exact, stratified_sample
from strandline.operators.sequences import day_masks, future_labels
from strandline.sources.tables import load

CATALOG = Catalog()


@CATALOG.add("p1_default_time", events_sql("SELECT event_id, coalesce(column3, '000000') AS column3 FROM e"))
def times(spark, sf):
    return default_time(events(spark, sf)).select("event_id", "column3")


def _route(name, code):
    @CATALOG.add(name, events_sql(f"SELECT event_id, column3, evnt FROM routed WHERE column5 = '{code}'"))
    def run(spark, sf):
        one = {code: ROUTES[code]}
        return route_events(default_time(events(spark, sf)), one).select("event_id", "column3", "evnt")

    return run


_route("p2_code_filter", "click")
_route("p3_single_route", "view")
_route("p4_conditional_route", "purchase")
_route("p5_pair_route", "error")


@CATALOG.add("p6_route_events", events_sql("SELECT event_id, column1, column2, column3, column5, evnt FROM routed"))
def all_routes(spark, sf):
    rows = route_events(default_time(events(spark, sf)), ROUTES)
    return rows.select("event_id", "column1", "column2", "column3", "column5", "evnt")


@CATALOG.add(
    "p7_cast_columns",
    """SELECT CAST(c_custkey AS float) AS c_custkey, c_name, CAST(c_nationkey AS smallint) AS c_nationkey,
              CAST(c_acctbal AS float) AS c_acctbal, c_mktsegment FROM customer""",
)
def casts(spark, sf):
    return cast_columns(load(spark, sf, "customer"), {"c_nationkey": "smallint"}, numeric_to_float=True)


@CATALOG.add("p8_select_regex", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def regex_columns(spark, sf):
    return select_regex(load(spark, sf, "lineitem"), "l_.*key")


@CATALOG.add("p9_drop_keep", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def kept_columns(spark, sf):
    return load(spark, sf, "customer").drop("c_acctbal")


_MASKS_SQL = "SELECT column1, column2, mask FROM frames"


def _masks(spark, sf):
    return future_labels(day_masks(routed(spark, sf)))


@CATALOG.add(
    "p10_keep_positive",
    events_sql(f"SELECT column1, column2, {flags_sql('mask')} AS y FROM frames WHERE mask <> 0"),
)
def positive(spark, sf):
    kept = keep_positive(multi_hot(_masks(spark, sf)))
    return kept.select("column1", "column2", F.array_join("y", ",").alias("y"))


@CATALOG.add("p11_rename", "SELECT c_custkey AS column1, c_name AS name, c_acctbal FROM customer")
def renamed(spark, sf):
    rows = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return rename(rows, {"c_custkey": "column1", "c_name": "name"})


@CATALOG.add(
    "j1_join_current",
    f"""WITH {EVENTS_SQL}, {DIMENSION_SQL}
        SELECT event_id, col2, class_code FROM e
        LEFT JOIN dim ON col2 = key_col AND end_date = '9999-12-31' AND class_code = '2222'""",
)
def current(spark, sf):
    rows = events(spark, sf).select("event_id", "col2")
    dim = dimension(spark, sf)
    return join_current(
        rows, dim, "col2", "key_col", "end_date", extra=F.col("class_code") == "2222", columns=("class_code",)
    )


@CATALOG.add(
    "j2_join_codes",
    events_sql("""SELECT event_id, column5, code FROM e
                  LEFT JOIN (SELECT DISTINCT event_type AS code FROM events WHERE event_type <> 'error') ON column5 = code"""),
)
def codes(spark, sf):
    table = load(spark, sf, "events").select(F.col("event_type").alias("code")).filter("code <> 'error'").distinct()
    return join_codes(events(spark, sf).select("event_id", "column5"), table, "column5", "code", ("code",))


@CATALOG.add(
    "o1_total_order", events_sql("SELECT column1, column2, column3, event_id FROM routed ORDER BY 1, 2, 3, 4")
)
def ordered(spark, sf):
    rows = routed(spark, sf).select("column1", "column2", "column3", "event_id")
    return order_output(rows, "column1", "column2", "column3", "event_id")


@CATALOG.add(
    "o2_preview", events_sql("SELECT event_id, column1, column2, evnt FROM routed ORDER BY column1, column2, event_id LIMIT 10")
)
def first_rows(spark, sf):
    return preview(routed(spark, sf), "column1", "column2", "event_id").select("event_id", "column1", "column2", "evnt")


@CATALOG.add(
    "o3_union_all",
    events_sql("""SELECT event_id, evnt FROM routed WHERE column5 IN ('click', 'error')
                  UNION ALL SELECT event_id, evnt FROM routed"""),
)
def union(spark, sf):
    raw = default_time(events(spark, sf))
    frames = [route_events(raw, {code: ROUTES[code]}).select("event_id", "evnt") for code in ("click", "error")]
    return union_all(*frames, route_events(raw, ROUTES).select("evnt", "event_id"))


@CATALOG.add("o4_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct(spark, sf):
    return load(spark, sf, "orders").select("o_custkey", "o_orderstatus").dropDuplicates()


@CATALOG.add("b1_label_events", events_sql("SELECT event_id, evnt, CAST(label AS int) AS label FROM labelled"))
def labels(spark, sf):
    rows = route_events(default_time(events(spark, sf)), ROUTES)
    return label_events(rows, RULES).select("event_id", "evnt", "label")


@CATALOG.add("b2_multi_hot", events_sql(f"SELECT column1, column2, {flags_sql('mask')} AS y FROM frames"))
def hot(spark, sf):
    return multi_hot(_masks(spark, sf)).select("column1", "column2", F.array_join("y", ",").alias("y"))


@CATALOG.add("b3_label_sum", events_sql('SELECT column1, column2, CAST(bit_count(mask) AS int) AS "sum" FROM frames'))
def sums(spark, sf):
    return label_sum(multi_hot(_masks(spark, sf))).select("column1", "column2", "sum")


@CATALOG.add("b4_label_vector", "SELECT doc_id, CAST(quality AS float) AS value, 1 AS width FROM labels")
def vector(spark, sf):
    rows = label_vector(load(spark, sf, "labels"), "quality")
    return rows.select("doc_id", F.col("labels")[0].alias("value"), F.size("labels").alias("width"))


_FEATS = ("cust_bin1", "cust_bin2", "cust_bin10")
_SHIFTED_SQL = ", ".join(f"CAST(coalesce({c} + 1, 0) AS int) AS {c}" for c in _FEATS)


@CATALOG.add("f1_shift_ids", f"WITH {FEATURES_SQL} SELECT column1, {_SHIFTED_SQL} FROM feats")
def shifted(spark, sf):
    return shift_ids(features(spark, sf), ["column1"])


@CATALOG.add(
    "f2_int_ids",
    "SELECT c_custkey, CAST(coalesce(c_nationkey + 1, 0) AS int) AS c_nationkey, CAST(coalesce(seg + 1, 0) AS int) AS seg"
    " FROM (SELECT c_custkey, c_nationkey, length(c_mktsegment) AS seg FROM customer)",
)
def int_ids(spark, sf):
    rows = load(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", F.length("c_mktsegment").cast("long").alias("seg")
    )
    return shift_ids(rows, ["c_custkey"])


def _check_sql(col, size):
    return f"""SELECT '{col}' AS feature, min({col}) AS min_id, max({col}) AS max_id,
      round(avg(CAST({col} = 0 AS int)), 6) AS missing_rate,
      count(*) FILTER (WHERE {col} < 0 OR {col} >= {size}) AS out_of_range FROM shifted"""


_SIZES = {"cust_bin1": 2, "cust_bin2": 5, "cust_bin10": 10}


@CATALOG.add(
    "f3_check_ids",
    f"WITH {FEATURES_SQL}, shifted AS (SELECT column1, {_SHIFTED_SQL} FROM feats) "
    + " UNION ALL ".join(_check_sql(c, n) for c, n in _SIZES.items()),
)
def checked(spark, sf):
    report = check_ids(shift_ids(features(spark, sf), ["column1"]), _SIZES)
    return report.withColumn("missing_rate", F.round("missing_rate", 6))


@CATALOG.add(
    "f4_bucket_ids",
    events_sql("""SELECT event_id, CAST(CASE WHEN t < 6 THEN 1 WHEN t < 12 THEN 2 WHEN t < 18 THEN 3
                    WHEN t IS NULL THEN 0 ELSE 4 END AS int) AS time_id,
                  CAST(CASE WHEN value < 10 THEN 1 WHEN value < 20.5 THEN 2 WHEN value IS NULL THEN 0 ELSE 3 END AS int)
                    AS spending_id
                  FROM (SELECT event_id, CAST(substr(column3, 1, 2) AS int) AS t, value
                        FROM e JOIN (SELECT event_id, value FROM events) USING (event_id))"""),
)
def buckets(spark, sf):
    hour = F.when(F.col("event_id") % 10 != 0, F.hour("ts"))
    rows = load(spark, sf, "events").withColumn("hour", hour)
    rows = bucket_ids(bucket_ids(rows, "hour", [6, 12, 18], "time_id"), "value", [10, 20.5], "spending_id")
    return rows.select("event_id", "time_id", "spending_id")


@CATALOG.add(
    "f5_join_features",
    f"""WITH {EVENTS_SQL}, {FEATURES_SQL}
        SELECT column1, column2, coalesce(cust_bin1, 0) AS cust_bin1, coalesce(cust_bin2, 0) AS cust_bin2,
               coalesce(cust_bin10, 0) AS cust_bin10
        FROM days LEFT JOIN (SELECT * FROM feats WHERE column1 % 9 <> 0) USING (column1)""",
)
def joined_features(spark, sf):
    days = day_masks(routed(spark, sf)).select("column1", "column2")
    known = features(spark, sf).filter("column1 % 9 <> 0")
    return join_features(days, known, "column1")


@CATALOG.add(
    "x1_stratified_sample",
    f"""SELECT doc_id, quality FROM labels
        WHERE {draw_sql('42', 'doc_id')} < CASE quality WHEN 0 THEN 0.5 WHEN 1 THEN 0.1 ELSE 0 END""",
)
def sampled(spark, sf):
    rows = load(spark, sf, "labels").select("doc_id", "quality")
    return stratified_sample(rows, "quality", {0: 0.5, 1: 0.1}, "doc_id")


_SPLIT_SQL = (
    "CASE WHEN {0} < 0.2 THEN 'test' WHEN {1} < 0.1 THEN 'valid' ELSE 'train' END"
)


@CATALOG.add(
    "x2_split",
    f"""SELECT event_id, user_id, {_SPLIT_SQL.format(draw_sql('42', "'test'", 'user_id'), draw_sql('42', "'valid'", 'user_id'))} AS split,
               {_SPLIT_SQL.format(draw_sql('42', "'test'", 'event_id'), draw_sql('42', "'valid'", 'event_id'))} AS row_split
        FROM events""",
)
def splits(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "user_id")
    return split(split(rows, "user_id"), "event_id", name="row_split")


@CATALOG.add(
    "x2_split_exact",
    """WITH keys AS (SELECT DISTINCT user_id FROM events),
       first AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:test:' || user_id)) AS r, count(*) OVER () AS n FROM keys),
       tests AS (SELECT user_id FROM first WHERE r <= ceil(0.2::DOUBLE * n)),
       rest AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:valid:' || user_id)) AS r, count(*) OVER () AS n
                FROM keys WHERE user_id NOT IN (SELECT user_id FROM tests)),
       valids AS (SELECT user_id FROM rest WHERE r <= ceil(0.1::DOUBLE * n)),
       row_first AS (SELECT event_id, row_number() OVER (ORDER BY md5('42:test:' || event_id)) AS r, count(*) OVER () AS n FROM events),
       row_rest AS (SELECT event_id, row_number() OVER (ORDER BY md5('42:valid:' || event_id)) AS r, count(*) OVER () AS n
                    FROM row_first WHERE r > ceil(0.2::DOUBLE * n))
       SELECT e.event_id, user_id,
         CASE WHEN user_id IN (SELECT user_id FROM tests) THEN 'test' WHEN user_id IN (SELECT user_id FROM valids) THEN 'valid'
              ELSE 'train' END AS split,
         CASE WHEN q.r IS NULL THEN 'test' WHEN q.r <= ceil(0.1::DOUBLE * q.n) THEN 'valid' ELSE 'train' END AS row_split
       FROM events e LEFT JOIN row_rest q USING (event_id)""",
)
def exact_splits(spark, sf):
    """Customers stay together, and the sizes are those of the shares to the customer, or to the row."""
    rows = load(spark, sf, "events").select("event_id", "user_id")
    return split_exact(split_exact(rows, "user_id"), "event_id", name="row_split")
