"""Evaluation of scored tables: every figure is one aggregation."""

from pyspark.sql import Column, DataFrame, functions as F

from strandline.constants import IGNORE, MASK, THRESHOLD
from strandline.operators.ordering import with_running_totals


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the ratio is undefined."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0)))


def decide(df: DataFrame, logit: str = "logit", threshold: float = THRESHOLD) -> DataFrame:
    """Probability from the logit, and 1 where it is above the threshold."""
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(logit)))
    return df.withColumn("prob", prob).withColumn("pred", (F.col("prob") > threshold).cast("int"))


def binary_accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def _hits(label: Column, pred: Column) -> tuple[Column, Column, Column]:
    """True positives, positives found, positives there."""
    return F.sum(label * pred), F.sum(pred), F.sum(label)


def binary_prf(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    both, found, real = _hits(F.col(label), F.col(pred))
    return df.agg(both.alias("tp"), found.alias("found"), real.alias("real")).select(*_precision_recall_f1())


def _precision_recall_f1() -> list[Column]:
    return [
        _ratio(F.col("tp"), F.col("found")).alias("precision"),
        _ratio(F.col("tp"), F.col("real")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("found") + F.col("real")).alias("f1"),
    ]


def multilabel_f1(df: DataFrame, n_classes: int, average: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """F1 over 0/1 arrays: ``micro`` pools the counts, ``macro`` averages the classes."""
    if average not in ("micro", "macro"):
        raise ValueError("average is 'micro' or 'macro'")
    counts = []
    for k in range(n_classes):
        both, found, real = _hits(F.col(y)[k], F.col(pred)[k])
        counts.append(F.struct(both.alias("tp"), (found + real).alias("sides")))
    classes = df.agg(F.array(*counts).alias("c")).select(F.inline("c"))
    if average == "micro":
        return classes.agg(_ratio(2 * F.sum("tp"), F.sum("sides")).alias("f1"))
    return classes.agg(F.avg(_ratio(2 * F.col("tp"), F.col("sides"))).alias("f1"))


def _score_groups(df: DataFrame, label: str, prob: str) -> DataFrame:
    positive = F.col(label) == 1
    return df.groupBy(F.col(prob).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def auroc(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Area under ROC: share of (positive, negative) pairs in the right order, ties half."""
    groups = with_running_totals(_score_groups(df, label, prob), F.col("score"), {"below": "neg"})
    right = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return groups.agg((right / F.nullif(pairs, F.lit(0.0))).alias("auroc"))


def auprc(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Area under precision-recall as average precision: steps, no interpolation."""
    order = F.col("score").desc()
    groups = with_running_totals(_score_groups(df, label, prob), order, {"tp": "pos", "fp": "neg"})
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return groups.agg((steps / F.nullif(F.sum("pos").cast("double"), F.lit(0.0))).alias("auprc"))


def areas(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Both areas from one sort: ``auroc`` takes from all pairs those with the negative above, ties half."""
    groups = with_running_totals(_score_groups(df, label, prob), F.col("score").desc(), {"tp": "pos", "fp": "neg"})
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    wrong = F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2))
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return groups.agg(
        ((pairs - wrong) / F.nullif(pairs, F.lit(0.0))).alias("auroc"),
        (steps / F.nullif(F.sum("pos").cast("double"), F.lit(0.0))).alias("auprc"),
    )


def binary_figures(df: DataFrame, label: str = "label", pred: str = "pred", logit: str = "logit") -> DataFrame:
    """Accuracy, precision, recall, F1 and cross-entropy from one aggregation."""
    y, p = F.col(label), F.col(pred)
    both, found, real = _hits(y, p)
    sums = df.agg(
        F.avg((y == p).cast("double")).alias("accuracy"), both.alias("tp"), found.alias("found"), real.alias("real"),
        F.avg(_binary_loss(F.col(logit), y)).alias("loss"),
    )
    return sums.select("accuracy", *_precision_recall_f1(), "loss")


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", classes: tuple = (0, 1)) -> DataFrame:
    """Count and share of all rows for every cell of the grid, empty cells too.

    Values outside ``classes``, nulls too, have cells of their own, as null; these are left out while empty. So the
    counts add up to all rows.
    """
    known = [*classes, None]
    cells = [(a, b) for a in known for b in known]

    def is_class(col: str, value) -> Column:
        other = ~F.coalesce(F.col(col).isin(*classes), F.lit(False))
        return other if value is None else F.col(col) == value

    counts = [F.count_if(is_class(label, a) & is_class(pred, b)).alias(f"n{i}") for i, (a, b) in enumerate(cells)]
    total = F.count("*").alias("total")
    grid = [
        F.struct(
            F.lit(a).cast(df.schema[label].dataType).alias(label),
            F.lit(b).cast(df.schema[pred].dataType).alias(pred),
            F.col(f"n{i}").alias("n"),
            _ratio(F.col(f"n{i}"), F.col("total")).alias("share"),
        )
        for i, (a, b) in enumerate(cells)
    ]
    rows = df.agg(*counts, total).select(F.inline(F.array(*grid)))
    return rows.filter(F.col(label).isNotNull() & F.col(pred).isNotNull() | (F.col("n") > 0))


def _kept_pairs(first: str, second: str, keep) -> Column:
    """Entries of two arrays side by side, those for which keep(first, second) holds."""
    pairs = F.zip_with(first, second, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.filter(pairs, lambda p: keep(p["a"], p["b"]))


def token_accuracy(df: DataFrame, labels: str = "labels", preds: str = "preds", ignore: int | None = IGNORE) -> DataFrame:
    """Share of right tokens over all rows; ``ignore=None`` counts every position."""
    pairs = _kept_pairs(labels, preds, lambda a, b: F.lit(True) if ignore is None else a != ignore)
    counted = df.select(pairs.alias("p")).select(
        F.size("p").alias("n"), F.size(F.filter("p", lambda p: p["a"] == p["b"])).alias("right")
    )
    return counted.agg((F.sum("right") / F.nullif(F.sum("n"), F.lit(0))).alias("accuracy"))


def _slot_mean(df: DataFrame, labels: str, preds: str, input_ids: str, right, name: str) -> DataFrame:
    """Per row the share of masked slots that are right, then the mean over rows with slots."""
    slots = F.filter(
        F.arrays_zip(F.col(input_ids).alias("i"), F.col(labels).alias("a"), F.col(preds).alias("b")),
        lambda s: s["i"] == MASK,
    )
    share = F.size(F.filter("s", lambda s: right(s["a"], s["b"]))) / F.nullif(F.size("s"), F.lit(0))
    return df.select(slots.alias("s")).select(share.alias("share")).agg(F.avg("share").alias(name))


def slot_accuracy(df: DataFrame, labels: str = "labels", preds: str = "preds", input_ids: str = "input_ids") -> DataFrame:
    return _slot_mean(df, labels, preds, input_ids, lambda a, b: a == b, "accuracy")


def slot_prefix_accuracy(
    df: DataFrame, labels: str = "label_texts", preds: str = "pred_texts", input_ids: str = "input_ids"
) -> DataFrame:
    """Right when the prediction, up to its first '_', occurs in the true text."""
    return _slot_mean(
        df, labels, preds, input_ids, lambda a, b: F.contains(a, F.substring_index(b, "_", 1)), "p_accuracy"
    )


def bce_from_logits(df: DataFrame, label: str = "label", logit: str = "logit", reduction: str = "mean") -> DataFrame:
    """Binary cross-entropy that does not overflow for big logits."""
    loss = _binary_loss(F.col(logit), F.col(label))
    return df.agg({"mean": F.avg, "sum": F.sum}[reduction](loss).alias("loss"))


def _binary_loss(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def masked_ce(
    df: DataFrame, labels: str = "labels", probs: str = "probs", ignore: int = IGNORE, denom: float | None = None
) -> DataFrame:
    """Cross-entropy from the probability given to the true token, ignored labels left out.

    Mean over the counted tokens, or the sum divided by ``denom``.
    """
    pairs = _kept_pairs(labels, probs, lambda a, b: a != ignore)
    rows = df.select(
        F.aggregate(pairs, F.lit(0.0), lambda total, p: total - F.ln(p["b"])).alias("loss"), F.size(pairs).alias("n")
    )
    total = F.sum("loss")
    return rows.agg((total / (F.lit(float(denom)) if denom else F.nullif(F.sum("n"), F.lit(0)))).alias("loss"))


def mse(df: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    error = F.col(value) - F.col(label)
    return df.agg(F.avg(error * error).alias("loss"))
