"""Labelled texts with customer features to encoded rows with bounded feature ids."""

from pyspark.sql import DataFrame

from strandline.constants import SEED, WIDTH
from strandline.operators.encoding import encode, join_parts, pad_sequence
from strandline.operators.events import rename
from strandline.operators.features import shift_ids
from strandline.operators.labels import label_vector
from strandline.operators.sampling import split, stratified_sample


def feature_rows(
    df: DataFrame,
    vocab: DataFrame,
    mapping: dict[str, str],
    meta_columns: tuple[str, ...] = ("column1", "column2", "evnt", "label"),
    fractions: dict | None = None,
    row_key: str = "column1",
    subword: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """Sample by label, shift and rename the features, split by customer, encode, pad.

    Texts in several parts are joined first: one row per ``row_key`` with as many of its last words as a row has ids.
    """
    customer, _, text, label = meta_columns
    if "part" in df.columns:
        df = join_parts(df, row_key, text, WIDTH)
    if fractions:
        df = stratified_sample(df, label, fractions, row_key, seed)
    rows = rename(shift_ids(df, list(meta_columns) + [row_key]), mapping)
    rows = pad_sequence(encode(split(rows, customer, seed=seed), vocab, text, subword=subword))
    return label_vector(rows, label).drop(text, label)
