"""Scans, SQL texts, saved tables."""

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.operators.events import cast_columns

ENCODED_COLUMNS = ("input_ids", "token_type_ids", "attention_mask", "labels")


def load(spark: SparkSession, folder: str | None, name: str) -> DataFrame:
    """Parquet table in a folder, or a table of the catalog when there is no folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet") if folder else spark.table(name)


def spread(df: DataFrame) -> DataFrame:
    """Share a scan of few files among all cores, before work that costs more than the bytes.

    A table with a split for every core, as any big one has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_months(df: DataFrame, start: str, end: str, month: str = "part_yrmn") -> DataFrame:
    """Months start to end as ``yyyyMM``, both included; prunes folders when partitioned by it."""
    return df.filter(F.col(month).between(start, end))


def scan_until(df: DataFrame, date_col: str, end: str) -> DataFrame:
    """Rows up to and including the day ``end`` (``yyyy-MM-dd``, has to be a real date)."""
    day = datetime.date.fromisoformat(end)
    return df.filter(F.col(date_col) <= F.lit(day))


def run_sql(
    spark: SparkSession,
    sql: str | list[str],
    views: dict[str, DataFrame] | None = None,
    use_regex: bool = False,
) -> DataFrame | list[DataFrame]:
    """Lazy result of one SQL text, or the list of results of several. The views are gone afterwards.

    With ``use_regex`` a back-quoted name in a SELECT list is a pattern for column names.
    """
    shadowed = {name: spark.table(name) if _is_view(spark, name) else None for name in views or {}}
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    flag = "spark.sql.parser.quotedRegexColumnNames"
    before = spark.conf.get(flag)
    spark.conf.set(flag, str(use_regex).lower())
    try:
        results = [spark.sql(text) for text in ([sql] if isinstance(sql, str) else sql)]
    finally:
        spark.conf.set(flag, before)
        for name, kept in shadowed.items():
            kept.createOrReplaceTempView(name) if kept else spark.catalog.dropTempView(name)
    return results[0] if len(results) == 1 else results


def _is_view(spark: SparkSession, name: str) -> bool:
    return any(table.isTemporary and table.name == name for table in spark.catalog.listTables())


def save_table(
    df: DataFrame,
    target: str,
    mode: str = "error",
    partition_by: tuple[str, ...] = (),
    dynamic: bool = False,
) -> DataFrame:
    """Write to a path (has a '/') or a named table, and return the stored table.

    ``dynamic`` replaces only the partitions that occur in ``df``. Partitioned rows are
    rebalanced first: each folder gets few files, and adaptive execution splits a folder
    that holds most of the rows among several tasks.
    """
    spark = df.sparkSession
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    writer = rows.write.mode("overwrite" if dynamic else mode)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if "/" in target:
        writer.partitionBy(*partition_by).parquet(target)
        return spark.read.schema(df.schema).parquet(target)
    if dynamic and spark.catalog.tableExists(target):
        columns = spark.table(target).columns  # insertInto goes by position, and by the session's mode
        flag = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(flag)
        spark.conf.set(flag, "dynamic")
        try:
            rows.select(*columns).write.insertInto(target, overwrite=True)
        finally:
            spark.conf.set(flag, before)
    else:
        writer.partitionBy(*partition_by).saveAsTable(target)
    return spark.table(target)


def save_encoded(df: DataFrame, path: str, mode: str = "error") -> None:
    """Store encoded rows: id arrays stay arrays."""
    missing = {"input_ids", "attention_mask"} - set(df.columns)
    if missing:
        raise ValueError(f"not encoded rows, no column {sorted(missing)}")
    df.write.mode(mode).parquet(path)


def load_encoded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_typed(df: DataFrame, path: str, mode: str = "error", **cast_rules) -> DataFrame:
    """Cast by rule and write; whoever trains reads the files, the driver holds no rows."""
    return save_table(cast_columns(df, **cast_rules), path, mode)
