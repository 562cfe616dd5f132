"""Sequences, labelled windows, counts. The '_in_parts' twins cut every sequence into
parts small enough that all customers take the way made for very big ones."""

from pyspark.sql import functions as F

from catalog.registry import Catalog
from catalog.views import (
    RETAIL_ORDER,
    ROUTES,
    RULES,
    events,
    events_sql,
    flags_sql,
    retail,
    retail_sql,
    routed,
)
from strandline.operators.sequences import (
    customer_sequences,
    day_masks,
    day_sequences,
    future_labels,
    history,
    label_counts,
    label_customers,
    month_sequences,
    null_event_profile,
    to_text,
    unique_events,
    week_sequences,
)
from strandline.operators.vocabulary import word_counts
from strandline.plans.windows_job import window_dataset
from strandline.sources.tables import load

CATALOG = Catalog()


def _windows(spark, sf, **options):
    rows = window_dataset(events(spark, sf), ROUTES, RULES, **options)
    return rows.withColumn("y", F.array_join("y", ","))


@CATALOG.add(
    "labelled_windows",
    events_sql(f"SELECT column1, column2, 0::bigint AS part, x, {flags_sql('mask')} AS y FROM frames WHERE mask <> 0"),
)
def labelled_windows(spark, sf):
    return _windows(spark, sf)


def _parts_sql(size, where, mask):
    """Windows as stretches of the customer's numbered events, cut on its grid."""
    return f"""
, numbered AS (
  SELECT column1, column2, column3, event_id, evnt,
         row_number() OVER (PARTITION BY column1 ORDER BY column2, column3, event_id) - 1 AS pos FROM labelled),
pieces AS (
  SELECT f.column1, f.column2, f.mask, n.pos // {size} AS block, n.column2 AS d, n.pos, n.evnt
  FROM frames f JOIN numbered n
    ON n.column1 = f.column1 AND n.column2 BETWEEN f.column2 - INTERVAL 30 DAY AND f.column2
  WHERE {where})
SELECT column1, column2, CAST(block - min(block) OVER (PARTITION BY column1, column2) AS bigint) AS part,
       coalesce(string_agg(evnt, ' ' ORDER BY pos), '') AS x{mask}
FROM pieces GROUP BY column1, column2, block"""


@CATALOG.add(
    "labelled_windows_in_parts",
    events_sql(_parts_sql(20, "f.mask <> 0", f", {flags_sql('min(mask)')} AS y")),
)
def labelled_windows_in_parts(spark, sf):
    return _windows(spark, sf, part_size=20)


@CATALOG.add(
    "labelled_windows_complete",
    events_sql(
        f"""SELECT column1, column2, 0::bigint AS part, x, {flags_sql('mask')} AS y FROM frames
            WHERE mask <> 0 AND column2 + INTERVAL 7 DAY <= DATE '2024-01-30'"""
    ),
)
def labelled_windows_complete(spark, sf):
    return _windows(spark, sf, complete_until="2024-01-30")


_DAY_SQL = """SELECT column1, column2, 0::bigint AS part, coalesce(string_agg(evnt, ' ' ORDER BY column3, event_id), '') AS evnt{}
              FROM labelled GROUP BY column1, column2"""


@CATALOG.add(
    "a1_day_sequences",
    events_sql(_DAY_SQL.format(", string_agg(label, ',' ORDER BY column3, event_id) AS label")),
)
def day_rows(spark, sf):
    rows = to_text(day_sequences(routed(spark, sf), ("evnt", "label")))
    return rows.withColumn("label", F.array_join("label", ","))


@CATALOG.add(
    "a1_day_sequences_in_parts",
    events_sql("""SELECT column1, column2, pos // 3 AS part, coalesce(string_agg(evnt, ' ' ORDER BY pos), '') AS evnt
                  FROM (SELECT *, row_number() OVER (PARTITION BY column1, column2 ORDER BY column3, event_id) - 1 AS pos
                        FROM routed)
                  GROUP BY column1, column2, pos // 3"""),
)
def day_rows_in_parts(spark, sf):
    return to_text(day_sequences(routed(spark, sf), part_size=3))


@CATALOG.add("a2_text", events_sql("SELECT column1, column2, 0::bigint AS part, txt AS evnt FROM days"))
def day_texts(spark, sf):
    return to_text(day_sequences(routed(spark, sf)))


_RETAIL_AGG = "string_agg(evnt, ' ' ORDER BY column2, column3, l_orderkey, l_linenumber, evnt) AS evnt"


@CATALOG.add(
    "a3_week_sequences",
    retail_sql(f"""SELECT column1, CAST(year(column2) AS int) AS year, CAST(month(column2) AS int) AS month,
                     CAST(weekofyear(column2) AS int) AS evnt_w, 0::bigint AS part, {_RETAIL_AGG}
                   FROM retail GROUP BY ALL"""),
)
def weeks(spark, sf):
    return to_text(week_sequences(retail(spark, sf), order=RETAIL_ORDER))


@CATALOG.add(
    "a3_iso_week_sequences",
    retail_sql(f"""SELECT column1, CAST(date_trunc('week', column2) AS date) AS week_start, 0::bigint AS part, {_RETAIL_AGG}
                   FROM retail GROUP BY ALL"""),
)
def iso_weeks(spark, sf):
    return to_text(week_sequences(retail(spark, sf), iso=True, order=RETAIL_ORDER))


@CATALOG.add(
    "a4_month_sequences",
    retail_sql(f"""SELECT column1, CAST(date_trunc('month', column2) AS date) AS date, 0::bigint AS part, {_RETAIL_AGG}
                   FROM retail GROUP BY ALL"""),
)
def month_rows(spark, sf):
    return to_text(month_sequences(retail(spark, sf), order=RETAIL_ORDER))


@CATALOG.add(
    "a5_customer_sequences",
    retail_sql(f"SELECT column1, 0::bigint AS part, {_RETAIL_AGG} FROM retail GROUP BY column1"),
)
def customers(spark, sf):
    return to_text(customer_sequences(retail(spark, sf), order=RETAIL_ORDER))


@CATALOG.add(
    "a5_customer_sequences_in_parts",
    events_sql("""SELECT column1, pos // 25 AS part, coalesce(string_agg(evnt, ' ' ORDER BY pos), '') AS evnt
                  FROM (SELECT *, row_number() OVER (PARTITION BY column1 ORDER BY column2, column3, event_id) - 1 AS pos
                        FROM routed)
                  GROUP BY column1, pos // 25"""),
)
def customers_in_parts(spark, sf):
    return to_text(customer_sequences(routed(spark, sf), part_size=25))


@CATALOG.add("a6_label_counts", events_sql("SELECT CAST(label AS int) AS label, count(column1) AS cnt FROM labelled GROUP BY label"))
def counts(spark, sf):
    return label_counts(routed(spark, sf), "label")


@CATALOG.add(
    "a7_label_customers",
    events_sql("SELECT CAST(label AS int) AS label, count(DISTINCT column1) AS cnt FROM labelled GROUP BY label"),
)
def distinct_customers(spark, sf):
    return label_customers(routed(spark, sf), "label")


@CATALOG.add(
    "a8_null_events",
    events_sql("""SELECT column5, count(*) AS n_events, count(*) FILTER (WHERE evnt IS NULL) AS n_null
                  FROM routed GROUP BY column5"""),
)
def null_events(spark, sf):
    return null_event_profile(routed(spark, sf))


@CATALOG.add("a9_unique_events", events_sql("SELECT DISTINCT evnt FROM routed"))
def unique(spark, sf):
    return unique_events(routed(spark, sf))


@CATALOG.add(
    "a10_word_counts",
    r"""SELECT w AS word, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)
        WHERE w <> '' GROUP BY w HAVING count(*) >= 20 ORDER BY freq DESC, word LIMIT 500""",
)
def frequent_words(spark, sf):
    return word_counts(load(spark, sf, "documents"), "text", min_frequency=20, limit=500)


@CATALOG.add("w1_future_labels", events_sql("SELECT column1, column2, day_mask, mask FROM frames JOIN days USING (column1, column2)"))
def future(spark, sf):
    return future_labels(day_masks(routed(spark, sf)))


@CATALOG.add("w2_history", events_sql("SELECT column1, column2, 0::bigint AS part, x FROM frames"))
def past(spark, sf):
    return history(routed(spark, sf))


@CATALOG.add("w2_history_in_parts", events_sql(_parts_sql(16, "true", "")))
def past_in_parts(spark, sf):
    return history(routed(spark, sf), part_size=16)


@CATALOG.add(
    "w2_retail_history",
    retail_sql("""
, days AS (SELECT column1, column2, string_agg(evnt, ' ' ORDER BY column3, l_orderkey, l_linenumber, evnt) AS txt
           FROM retail GROUP BY column1, column2)
SELECT column1, column2, 0::bigint AS part,
       array_to_string(list(txt) OVER (PARTITION BY column1 ORDER BY column2::timestamp
         RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW), ' ') AS x
FROM days"""),
)
def retail_past(spark, sf):
    return history(retail(spark, sf), order=RETAIL_ORDER)
