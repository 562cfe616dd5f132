"""Ordered sequences per day, week, month and customer, and labelled windows.

Every sequence row holds at most ``part_size`` events. A longer sequence is several
rows numbered by ``part``; read in that order they are the whole sequence. So no
customer, however big, is gathered into one row or one task, and nothing is dropped.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.constants import DAYS_AHEAD, DAYS_BACK, N_CLASSES
from strandline.operators.labels import flags, label_bit
from strandline.operators.ordering import broadcast_if_small, heavy_keys, split_heavy, with_position

PART_SIZE = 50_000

CUSTOMER = "column1"
DAY = "column2"
ORDER = (DAY, "column3", "event_id")  # unique per customer: the last one breaks ties


def sequences(
    df: DataFrame,
    groups: dict[str, Column],
    order: tuple[str, ...] = ORDER,
    values: tuple[str, ...] = ("evnt",),
    customer: str = CUSTOMER,
    part_size: int = PART_SIZE,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Rows (groups, part, values): each value column as an array in event order.

    Null values are left out of the arrays, but a group with nothing else keeps its row.
    Customers with at most ``part_size`` events take one shuffle. The others are
    numbered by a range partitioned sort first and then gathered part by part. ``heavy``
    saves the pass that looks for them: the result of ``heavy_keys`` for this ``part_size``.
    """
    if heavy is None:
        heavy = heavy_keys(df, customer, part_size)
    rows = df.select(
        F.col(customer).alias("__customer"),
        *[c.alias(g) for g, c in groups.items()],
        F.struct(*[F.col(c) for c in (*order, *values)]).alias("__item"),
    )
    light, big = split_heavy(rows, "__customer", heavy)
    result = _gather(light.withColumn("part", F.lit(0).cast("long")), groups, values)
    if big is not None:
        result = result.unionByName(_gather(_with_parts(big, list(groups), part_size), groups, values))
    return result


def _with_parts(heavy: DataFrame, groups: list[str], part_size: int) -> DataFrame:
    """Number the rows inside their group and cut the group every ``part_size`` rows."""
    placed = with_position(heavy, *groups, "__item", name="__position")
    firsts = placed.groupBy(*[F.col(g).alias(f"__g_{g}") for g in groups]).agg(F.min("__position").alias("__first"))
    firsts = broadcast_if_small(firsts)
    same = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups]
    inside = F.col("__position") - F.col("__first")
    return placed.join(firsts, same).withColumn("part", F.floor(inside / F.lit(part_size)))


def _gather(rows: DataFrame, groups: dict[str, Column], values: tuple[str, ...]) -> DataFrame:
    """Lists do not shrink before the shuffle, so plain rows are shuffled and gathered after it."""
    gathered = rows.repartition(*groups, "part").groupBy(*groups, "part")
    items = gathered.agg(F.sort_array(F.collect_list("__item")).alias("__items"))
    return items.select(*groups, "part", *[F.array_compact(f"__items.{v}").alias(v) for v in values])


def to_text(df: DataFrame, col: str = "evnt") -> DataFrame:
    """Array to text, separated by single spaces."""
    return df.withColumn(col, F.array_join(col, " "))


def day_sequences(
    df: DataFrame,
    values: tuple[str, ...] = ("evnt",),
    order: tuple[str, ...] = ORDER,
    customer: str = CUSTOMER,
    day: str = DAY,
    **options,
) -> DataFrame:
    groups = {customer: F.col(customer), day: F.col(day)}
    inside = tuple(c for c in order if c != day)
    return sequences(df, groups, inside, values, customer, **options)


def week_sequences(df: DataFrame, iso: bool = False, customer: str = CUSTOMER, day: str = DAY, **options) -> DataFrame:
    """Per calendar year, month and ISO week, so a week over a month's end is two rows.

    ``iso=True`` keeps it whole and names it by its Monday.
    """
    if iso:
        groups = {customer: F.col(customer), "week_start": F.trunc(day, "week")}
    else:
        groups = {customer: F.col(customer), "year": F.year(day), "month": F.month(day), "evnt_w": F.weekofyear(day)}
    return sequences(df, groups, customer=customer, **options)


def month_sequences(df: DataFrame, customer: str = CUSTOMER, day: str = DAY, **options) -> DataFrame:
    return sequences(df, {customer: F.col(customer), "date": F.trunc(day, "month")}, customer=customer, **options)


def customer_sequences(df: DataFrame, customer: str = CUSTOMER, **options) -> DataFrame:
    return sequences(df, {customer: F.col(customer)}, customer=customer, **options)


def label_counts(df: DataFrame, label: str = "y", counted: str = CUSTOMER) -> DataFrame:
    """Rows with a customer, by label."""
    return df.groupBy(label).agg(F.count(counted).alias("cnt"))


def label_customers(df: DataFrame, label: str = "y", customer: str = CUSTOMER, approximate: bool = False) -> DataFrame:
    """Different customers by label."""
    how = F.approx_count_distinct if approximate else F.countDistinct
    return df.groupBy(label).agg(how(customer).alias("cnt"))


def null_event_profile(df: DataFrame, code: str = "column5", text: str = "evnt") -> DataFrame:
    """By event code: how many events, how many of them without a text."""
    return df.groupBy(code).agg(F.count("*").alias("n_events"), F.count_if(F.col(text).isNull()).alias("n_null"))


def unique_events(df: DataFrame, text: str = "evnt") -> DataFrame:
    return df.select(text).dropDuplicates()


def _by_day(customer: str, day: str):
    """A customer's rows along the calendar: range frames count days, whatever the time zone."""
    return Window.partitionBy(customer).orderBy(F.unix_date(day))


def day_masks(df: DataFrame, customer: str = CUSTOMER, day: str = DAY, label: str = "label") -> DataFrame:
    """One narrow row per customer and day: the set of the day's labels as bits.

    ``bit_or`` is combined before the shuffle, so a hot customer costs no more than others.
    """
    return df.groupBy(customer, day).agg(F.bit_or(label_bit(F.col(label))).alias("day_mask"))


def future_labels(days: DataFrame, ahead: int = DAYS_AHEAD, customer: str = CUSTOMER, day: str = DAY) -> DataFrame:
    """``mask``: labels of the customer's next days, today left out.

    The window holds one narrow row per day, so its size is bounded by the calendar.
    """
    return days.withColumn("mask", _future_mask(customer, day, ahead))


def _future_mask(customer: str, day: str, ahead: int) -> Column:
    frame = _by_day(customer, day).rangeBetween(1, ahead)
    return F.coalesce(F.bit_or("day_mask").over(frame), F.lit(0))


def labelled_windows(
    df: DataFrame,
    ahead: int = DAYS_AHEAD,
    back: int = DAYS_BACK,
    n_classes: int = N_CLASSES,
    order: tuple[str, ...] = ORDER,
    only_positive: bool = True,
    complete_until: str | None = None,
    customer: str = CUSTOMER,
    day: str = DAY,
    part_size: int = PART_SIZE,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Rows (customer, day, part, x, y) from labelled events.

    ``x`` is the text of the last ``back`` days and today, ``y`` the flags of the next
    ``ahead`` days. ``complete_until`` leaves out days whose future passes that date.
    Customers with at most ``part_size`` events take one shuffle for everything.
    """
    if heavy is None:
        heavy = heavy_keys(df, customer, part_size)
    light, big = split_heavy(df, customer, heavy)
    result = _light_windows(light, ahead, back, order, only_positive, customer, day)
    if big is not None:
        long = _heavy_windows(big, ahead, back, order, only_positive, customer, day, part_size)
        result = result.unionByName(long)
    if complete_until is not None:
        result = result.filter(F.date_add(F.col(day), ahead) <= F.lit(complete_until).cast("date"))
    return result.select(customer, day, "part", "x", flags(F.col("mask"), n_classes).alias("y"))


def _light_windows(df, ahead, back, order, only_positive, customer, day) -> DataFrame:
    """Grouping and both frames share the one exchange by customer."""
    item = F.struct(*[F.col(c) for c in (*order, "evnt") if c != day])
    days = (
        df.repartition(customer)
        .groupBy(customer, day)
        .agg(F.sort_array(F.collect_list(item)).alias("__items"), F.bit_or(label_bit(F.col("label"))).alias("day_mask"))
        .withColumn("__text", F.array_join("__items.evnt", " "))
    )
    past = _by_day(customer, day).rangeBetween(-back, 0)
    windows = days.select(
        customer,
        day,
        _future_mask(customer, day, ahead).alias("mask"),
        F.collect_list("__text").over(past).alias("__texts"),
    )
    if only_positive:
        windows = windows.filter(F.col("mask") != 0)
    text = F.array_join(F.filter("__texts", lambda t: t != ""), " ")
    return windows.select(customer, day, F.lit(0).cast("long").alias("part"), text.alias("x"), "mask")


def _heavy_windows(df, ahead, back, order, only_positive, customer, day, part_size) -> DataFrame:
    """The same rows for customers too big for one task.

    Their events are stored once as blocks of ``part_size`` consecutive events. A window
    is a stretch of positions: it meets the blocks it covers by an equi-join and clips
    the first and the last one. Days, targets and the join stay bounded per key.
    """
    item = F.struct(*[F.col(c) for c in order], F.col("evnt"))
    rows = df.select(customer, day, item.alias("__item"), "label")
    placed = with_position(rows, customer, "__item", name="__global")
    days = placed.groupBy(customer, day).agg(
        F.min("__global").alias("__first"),
        F.max("__global").alias("__last"),
        F.bit_or(label_bit(F.col("label"))).alias("day_mask"),
    )
    past = _by_day(customer, day).rangeBetween(-back, 0)
    origin = F.min("__first").over(Window.partitionBy(customer))
    targets = days.select(
        customer,
        day,
        _future_mask(customer, day, ahead).alias("mask"),
        (F.min("__first").over(past) - origin).alias("__from"),
        (F.col("__last") - origin).alias("__to"),
    )
    if only_positive:
        targets = targets.filter(F.col("mask") != 0)

    origins = days.groupBy(F.col(customer).alias("__owner")).agg(F.min("__first").alias("__origin"))
    own = F.col(customer).eqNullSafe(F.col("__owner"))
    inside = F.col("__global") - F.col("__origin")
    blocks = (
        placed.join(broadcast_if_small(origins), own)
        .withColumn("__block", F.floor(inside / F.lit(part_size)))
        .groupBy("__owner", "__block")
        .agg(F.sort_array(F.collect_list("__item")).alias("__items"))
    )
    pieces = targets.withColumn(
        "__wanted",
        F.explode(F.sequence(F.floor(F.col("__from") / part_size), F.floor(F.col("__to") / part_size))),
    )
    met = pieces.join(blocks, own & (F.col("__wanted") == F.col("__block")))
    block_start = F.col("__block") * part_size
    low = F.greatest(F.col("__from") - block_start, F.lit(0))
    high = F.least(F.col("__to") - block_start, F.lit(part_size - 1))
    clipped = F.slice("__items", (low + 1).cast("int"), (high - low + 1).cast("int"))
    return met.select(
        customer,
        day,
        (F.col("__wanted") - F.floor(F.col("__from") / part_size)).alias("part"),
        F.array_join(clipped["evnt"], " ").alias("x"),
        "mask",
    )


def history(df: DataFrame, back: int = DAYS_BACK, **options) -> DataFrame:
    """Rows (customer, day, part, x): every day with its last ``back`` days of text."""
    unlabelled = df.withColumn("label", F.lit(0))
    return labelled_windows(unlabelled, back=back, only_positive=False, **options).drop("y")
