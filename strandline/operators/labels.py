"""Labels from event texts."""

from pyspark.sql import Column, DataFrame, functions as F

from strandline.constants import N_CLASSES

#: Classes are bits of a long; the sign is left alone.
MAX_CLASS = 63

Rule = tuple[str, int, str]  # pattern, class, 'contains' or 'equals'


def label_of(text: Column, rules: list[Rule], default: int = 0) -> Column:
    """Class of the first rule that fits the text; ``default`` if none or null."""
    tests = {"contains": lambda p: text.contains(p), "equals": lambda p: text == p}
    label = F.lit(default)
    for pattern, number, how in reversed(rules):
        label = F.when(tests[how](pattern), F.lit(number)).otherwise(label)
    return label.cast("int")


def label_events(df: DataFrame, rules: list[Rule], default: int = 0, text: str = "evnt", name: str = "label") -> DataFrame:
    return df.withColumn(name, label_of(F.col(text), rules, default))


def label_bit(label: Column) -> Column:
    """Bit k-1 for class k, no bit for class 0 or null; ``bit_or`` then collects a set. Classes beyond 63 fail."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), label - 1)
    too_big = F.raise_error(F.concat(F.lit("no bit for class "), label.cast("string"))).cast("long")
    return F.when(label > MAX_CLASS, too_big).when(label > 0, bit).otherwise(F.lit(0).cast("long"))


def flags(mask: Column, n_classes: int = N_CLASSES) -> Column:
    """Label set as an array of n 0/1 flags. A set with a class beyond ``n_classes`` fails: it has no flag."""
    known = F.array(*[F.shiftright(mask, k).bitwiseAND(F.lit(1)).cast("int") for k in range(n_classes)])
    too_big = F.raise_error(F.lit(f"a label is beyond the {n_classes} classes")).cast("array<int>")
    return F.when(F.shiftright(mask, n_classes) != 0, too_big).otherwise(known)


def multi_hot(df: DataFrame, mask: str = "mask", n_classes: int = N_CLASSES, name: str = "y") -> DataFrame:
    return df.withColumn(name, flags(F.col(mask), n_classes))


def label_sum(df: DataFrame, y: str = "y", name: str = "sum") -> DataFrame:
    """How many classes are set."""
    return df.withColumn(name, F.aggregate(y, F.lit(0), lambda total, flag: total + flag))


def keep_positive(df: DataFrame, y: str = "y") -> DataFrame:
    """Rows with at least one class set."""
    return df.filter(F.exists(y, lambda flag: flag > 0))


def label_vector(df: DataFrame, label: str = "label", name: str = "labels") -> DataFrame:
    """Binary label as an array with one float."""
    return df.withColumn(name, F.array(F.col(label).cast("float")))
