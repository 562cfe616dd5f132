"""A scored table to one row per figure."""

from pyspark.sql import DataFrame, functions as F

from strandline.operators.evaluate import areas, binary_figures, decide


def evaluation_report(df: DataFrame, label: str = "label", logit: str = "logit") -> DataFrame:
    """Rows (metric, value) for a binary task: one aggregation of the rows, one sort of the scores."""
    scored = decide(df, logit)

    def long(figures: DataFrame) -> DataFrame:
        rows = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in figures.columns]
        return figures.select(F.inline(F.array(*rows)))

    return long(binary_figures(scored, label, logit=logit)).unionByName(long(areas(scored, label)))
