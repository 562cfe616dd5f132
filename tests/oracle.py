"""Runs a query in Spark and its twin in DuckDB and compares types and rows."""

import glob
import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


DUCK_TO_SPARK = {
    "BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "smallint", "VARCHAR": "string", "DOUBLE": "double",
    "FLOAT": "float", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "HUGEINT": "bigint", "BOOLEAN": "boolean",
}


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def differences(df, con, sql) -> list[str]:
    names = sorted(df.columns)
    cursor = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})")
    found = []
    spark_types = dict(df.dtypes)
    for name, kind in zip(names, [str(d[1]) for d in cursor.description]):
        if DUCK_TO_SPARK.get(kind, kind) != spark_types[name]:
            found.append(f"{name}: {spark_types[name]} in Spark, {kind} in DuckDB")
    want = sorted(cursor.fetchall(), key=_key)
    got = sorted([tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()], key=_key)
    if len(got) != len(want):
        found.append(f"{len(got)} rows in Spark, {len(want)} in DuckDB")
    wrong = [(g, w) for g, w in zip(got, want) if not all(map(_same, g, w))]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {str(wrong[0][0])[:600]} <> {str(wrong[0][1])[:600]}")
    if not want:
        found.append("no rows to compare")
    return found


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b
