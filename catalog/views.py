"""The test tables in the shape of event tables, for Spark and as SQL text."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions.hashing import draw
from strandline.operators.events import Route
from strandline.plans.windows_job import labelled_events
from strandline.sources.tables import load

ROUTES = {
    "click": Route.single("col1"),
    "view": Route.single("col2"),
    "purchase": Route.conditional("col1", "col2"),
    "signup": Route.pair("col1", "col2"),
    "error": Route.pair("col1", "col3"),
}
RULES = [  # equality is tested first, then containment of every pattern in order
    ("k4", 4, "equals"),
    ("k1", 1, "contains"),
    ("k2", 2, "contains"),
    ("k3", 3, "contains"),
    ("k4", 4, "contains"),
    ("k5", 5, "contains"),
    ("k6", 6, "contains"),
    ("k7", 7, "contains"),
]


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows: times are missing on every tenth row, col3 on every fourth."""
    event = F.col("event_id")
    text = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    return load(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("column1"),
        F.col("ts").cast("date").alias("column2"),
        F.when(event % 10 != 0, F.date_format("ts", "HHmmss")).alias("column3"),
        F.when(event % 3 == 0, 1111).otherwise(2000 + event % 7).cast("int").alias("column4"),
        F.col("event_type").alias("column5"),
        F.col("event_type").alias("col1"),
        F.when(event % 4 == 0, "-").otherwise(text).alias("col2"),
        F.when(event % 4 != 0, text).alias("col3"),
        F.date_format("ts", "yyyyMM").alias("part_yrmn"),
    )


def routed(spark: SparkSession, sf: str) -> DataFrame:
    """Routed and labelled events."""
    return labelled_events(events(spark, sf), ROUTES, RULES)


EVENTS_SQL = """
e AS (
  SELECT event_id, user_id AS column1, CAST(ts AS date) AS column2,
         CASE WHEN event_id % 10 <> 0 THEN strftime(ts, '%H%M%S') END AS column3,
         CAST(CASE WHEN event_id % 3 = 0 THEN 1111 ELSE 2000 + event_id % 7 END AS int) AS column4,
         event_type AS column5, event_type AS col1,
         CASE WHEN event_id % 4 = 0 THEN '-' ELSE 'k' || json_extract_string(props, '$.k') END AS col2,
         CASE WHEN event_id % 4 <> 0 THEN 'k' || json_extract_string(props, '$.k') END AS col3,
         strftime(ts, '%Y%m') AS part_yrmn
  FROM events),
routed AS (
  SELECT event_id, column1, column2, coalesce(column3, '000000') AS column3, column4, column5,
         CASE column5
           WHEN 'click' THEN col1
           WHEN 'view' THEN col2
           WHEN 'purchase' THEN CASE WHEN column4 <> 1111 OR (column4 = 1111 AND col2 = '-') THEN col1
                                     WHEN column4 = 1111 AND col2 <> '-' THEN col2 END
           WHEN 'signup' THEN col1 || '_' || col2
           WHEN 'error' THEN col1 || '_' || col3
         END AS evnt
  FROM e WHERE column5 IN ('click', 'view', 'purchase', 'signup', 'error')),
labelled AS (
  SELECT *, CASE WHEN evnt = 'k4' THEN 4 WHEN contains(evnt, 'k1') THEN 1 WHEN contains(evnt, 'k2') THEN 2
                 WHEN contains(evnt, 'k3') THEN 3 WHEN contains(evnt, 'k4') THEN 4
                 WHEN contains(evnt, 'k5') THEN 5 WHEN contains(evnt, 'k6') THEN 6
                 WHEN contains(evnt, 'k7') THEN 7 ELSE 0 END AS label
  FROM routed),
days AS (
  SELECT column1, column2,
         coalesce(string_agg(evnt, ' ' ORDER BY column3, event_id), '') AS txt,
         bit_or(CASE WHEN label > 0 THEN 1 << (label - 1) ELSE 0 END)::bigint AS day_mask
  FROM labelled GROUP BY column1, column2),
frames AS (
  SELECT column1, column2,
         coalesce(bit_or(day_mask) OVER (PARTITION BY column1 ORDER BY column2::timestamp
           RANGE BETWEEN INTERVAL 1 SECOND FOLLOWING AND INTERVAL 7 DAY FOLLOWING), 0)::bigint AS mask,
         array_to_string(list_filter(list(txt) OVER (PARTITION BY column1 ORDER BY column2::timestamp
           RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW), lambda t: t <> ''), ' ') AS x
  FROM days)
"""


def events_sql(body: str) -> str:
    return f"WITH {EVENTS_SQL} {body}"


def flags_sql(mask: str) -> str:
    """The seven flags as one text."""
    return "concat_ws(',', " + ", ".join(f"({mask} >> {k}) & 1" for k in range(7)) + ")"


def retail(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as events: months, year ends and long gaps."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    parts = load(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    joined = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(parts, F.col("p_partkey") == F.col("l_partkey"))
    return joined.select(
        F.col("o_custkey").alias("column1"),
        F.col("o_orderdate").cast("date").alias("column2"),
        F.lpad(F.col("l_linenumber").cast("string"), 6, "0").alias("column3"),
        F.col("l_returnflag").alias("column5"),
        F.concat_ws("_", "p_type", "p_brand").alias("evnt"),
        "l_orderkey",
        "l_linenumber",
    )


RETAIL_ORDER = ("column2", "column3", "l_orderkey", "l_linenumber")
RETAIL_SQL = """
retail AS (
  SELECT o_custkey AS column1, CAST(o_orderdate AS date) AS column2,
         lpad(CAST(l_linenumber AS varchar), 6, '0') AS column3, l_returnflag AS column5,
         p_type || '_' || p_brand AS evnt, l_orderkey, l_linenumber
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
"""


def retail_sql(body: str) -> str:
    return f"WITH {RETAIL_SQL} {body}"


def dimension(spark: SparkSession, sf: str) -> DataFrame:
    """One row per text key, half of them out of date, with a class code."""
    i = F.get_json_object("props", "$.k").cast("int")
    return (
        load(spark, sf, "events")
        .select(i.alias("i"))
        .distinct()
        .select(
            F.concat(F.lit("k"), F.col("i").cast("string")).alias("key_col"),
            F.when(F.col("i") % 2 == 0, "9999-12-31").otherwise("2023-12-31").alias("end_date"),
            F.when(F.col("i") % 3 == 0, "2222").otherwise("1111").alias("class_code"),
        )
    )


DIMENSION_SQL = """
dim AS (
  SELECT DISTINCT 'k' || i AS key_col,
         CASE WHEN i % 2 = 0 THEN '9999-12-31' ELSE '2023-12-31' END AS end_date,
         CASE WHEN i % 3 = 0 THEN '2222' ELSE '1111' END AS class_code
  FROM (SELECT CAST(json_extract_string(props, '$.k') AS int) AS i FROM events))
"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    return (
        load(spark, sf, "events")
        .select(
            user.alias("column1"),
            F.when(user % 5 != 0, user % 2).cast("int").alias("cust_bin1"),
            F.when(user % 7 != 0, user % 4).cast("int").alias("cust_bin2"),
            (user % 12).cast("int").alias("cust_bin10"),
        )
        .distinct()
    )


FEATURES_SQL = """
feats AS (
  SELECT DISTINCT user_id AS column1,
         CAST(CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 2 END AS int) AS cust_bin1,
         CAST(CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 4 END AS int) AS cust_bin2,
         CAST(user_id % 12 AS int) AS cust_bin10
  FROM events)
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Two classes with repeatable probabilities; ``tied`` has ties."""
    prob, prob2 = draw("s", F.col("doc_id")), draw("t", F.col("doc_id"))
    return load(spark, sf, "labels").select(
        "doc_id",
        F.col("quality").alias("label"),
        "toxic",
        prob.alias("prob"),
        prob2.alias("prob2"),
        F.ln(prob / (1 - prob)).alias("logit"),
        F.round(prob, 1).alias("tied"),
    )


SCORED_SQL = """
s0 AS (
  SELECT doc_id, quality AS label, toxic,
         ('0x' || substr(md5('s:' || doc_id), 1, 8))::bigint / 4294967296.0::double AS prob,
         ('0x' || substr(md5('t:' || doc_id), 1, 8))::bigint / 4294967296.0::double AS prob2
  FROM labels),
s AS (SELECT *, ln(prob / (1 - prob)) AS logit, round(prob, 1) AS tied,
             CAST(prob > 0.5 AS int) AS pred, CAST(prob2 > 0.5 AS int) AS pred2 FROM s0)
"""


def scored_sql(body: str) -> str:
    return f"WITH {SCORED_SQL} {body}"


def hash_sql(*parts: str) -> str:
    """The 32-bit hash of the library, in SQL."""
    text = " || ':' || ".join(f"CAST({p} AS varchar)" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def draw_sql(*parts: str) -> str:
    return f"({hash_sql(*parts)} / 4294967296.0::double)"


# Documents as texts: words between white space, in one vocabulary.
WORDS_SQL = r"""
docs AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws
  FROM documents),
counts AS (
  SELECT w AS piece, count(*) AS freq FROM (SELECT unnest(ws) AS w FROM docs) GROUP BY w),
vocab AS (
  SELECT piece, CAST(4 + row_number() OVER (ORDER BY freq DESC, piece) AS int) AS id, freq
  FROM counts WHERE freq >= 20),
ids AS (
  SELECT doc_id, list(id ORDER BY i) AS ids
  FROM (SELECT doc_id, i, coalesce(v.id, 0) AS id
        FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs)
        LEFT JOIN vocab v ON v.piece = w)
  GROUP BY doc_id)
"""


def words_sql(body: str) -> str:
    return f"WITH {WORDS_SQL} {body}"
