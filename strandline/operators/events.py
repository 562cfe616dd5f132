"""Event rows: routing, defaults, casts, selection, dimension joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandline.constants import CURRENT_END_DATE, MISSING_TEXT, MISSING_TIME, SPECIAL_CHANNEL


@dataclass(frozen=True)
class Route:
    """How the event text of one event code is put together."""

    text: Callable[[], Column]

    @staticmethod
    def single(col: str) -> Route:
        return Route(lambda: F.col(col))

    @staticmethod
    def pair(first: str, second: str) -> Route:
        """Both texts joined by '_'; null when either is null."""
        return Route(lambda: F.concat(F.col(first), F.lit("_"), F.col(second)))

    @staticmethod
    def conditional(
        usual: str,
        special: str,
        channel: str = "column4",
        special_channel: int = SPECIAL_CHANNEL,
        missing: str = MISSING_TEXT,
    ) -> Route:
        """``special`` on the special channel where it is filled in, else ``usual``.

        An unknown channel, or an unknown text on the special channel, gives null.
        """

        def text() -> Column:
            filled = F.col(special) != missing
            on_special = F.col(channel) == special_channel
            return F.when(on_special, F.when(filled, F.col(special)).when(~filled, F.col(usual))).when(
                ~on_special, F.col(usual)
            )

        return Route(text)


def default_time(df: DataFrame, col: str = "column3", default: str = MISSING_TIME) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(default)))


def route_events(df: DataFrame, routes: dict[str, Route], code: str = "column5", name: str = "evnt") -> DataFrame:
    """Event text by code, for the codes that have a route, in one pass over the rows."""
    text = F.lit(None).cast("string")
    for value, route in routes.items():
        text = F.when(F.col(code) == value, route.text()).otherwise(text)
    return df.filter(F.col(code).isin(*routes)).withColumn(name, text)


CAST_TARGETS = {"tinyint", "smallint", "short", "int", "bigint", "boolean", "float", "double", "string"}


def cast_columns(
    df: DataFrame,
    cast_dict: dict[str, str] | None = None,
    convert_decimal: bool = True,
    numeric_to_float: bool = False,
    double_to_float: bool = False,
    bigint_to_int: bool = False,
) -> DataFrame:
    """Narrow column types by schema; a wish in ``cast_dict`` beats every rule."""
    wishes = dict(cast_dict or {})
    unknown = set(wishes.values()) - CAST_TARGETS
    if unknown:
        raise ValueError(f"unsupported cast targets {sorted(unknown)}; use one of {sorted(CAST_TARGETS)}")
    whole = "int" if bigint_to_int else "bigint"
    real = "float" if double_to_float else "double"

    def target(field: T.StructField) -> str | None:
        kind = field.dataType
        if field.name in wishes:
            return wishes[field.name]
        if numeric_to_float and isinstance(kind, T.NumericType):
            return "float"
        if convert_decimal and isinstance(kind, T.DecimalType):
            return whole if kind.scale == 0 else real
        if double_to_float and isinstance(kind, T.DoubleType):
            return "float"
        if bigint_to_int and isinstance(kind, T.LongType):
            return "int"
        return None

    casts = {f.name: target(f) for f in df.schema.fields}
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in casts.items() if t})


def select_regex(df: DataFrame, pattern: str) -> DataFrame:
    """The columns whose whole name matches the pattern."""
    return df.select(df.colRegex(f"`{pattern}`"))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def join_current(
    df: DataFrame,
    dim: DataFrame,
    left: str,
    right: str,
    end_col: str,
    end: str = CURRENT_END_DATE,
    extra: Column | None = None,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """Left join to the rows of a dimension that are valid now; unmatched rows stay.

    The limits on the dimension act before the join, as they would in ``ON``. No hint
    is given: Spark broadcasts the dimension while it is small and shuffles otherwise.
    """
    current = dim.filter(F.col(end_col) == end)
    if extra is not None:
        current = current.filter(extra)
    return _left_join(df, current, left, right, columns)


def join_codes(df: DataFrame, codes: DataFrame, left: str, right: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Left join to a code table."""
    return _left_join(df, codes, left, right, columns)


def _left_join(df: DataFrame, dim: DataFrame, left: str, right: str, columns: tuple[str, ...]) -> DataFrame:
    """A dimension has one row per key: repeated rows count once, two different ones fail.

    ``count``/``min`` are combined before their shuffle, so a key that fills most of the
    dimension stays cheap, and the check is part of the lazy plan.
    """
    kept = F.struct(*[F.col(c) for c in columns]) if columns else F.struct(F.lit(1).alias("one"))
    one = (
        dim.filter(F.col(right).isNotNull())
        .groupBy(F.col(right).alias("__key"))
        .agg(F.min(kept).alias("__low"), F.max(kept).alias("__high"))
        .withColumn(
            "__row",
            F.when(F.col("__low").eqNullSafe(F.col("__high")), F.col("__low")).otherwise(
                F.raise_error(F.concat(F.lit("two rows for dimension key "), F.col("__key").cast("string")))
            ),
        )
    )
    joined = df.join(one, F.col(left) == F.col("__key"), "left")
    return joined.select(*[df[c] for c in df.columns], *[F.col(f"__row.{c}").alias(c) for c in columns])
