"""Exact duplicates by recipes of content-defined chunks, in DataFrame functions only.

A text without white space is cut at the ends of its sentences, so equal passages give equal chunks wherever they
stand. Each distinct chunk is moved once, to prove that its 64-bit identifier stands for one content. After that a
document is the ordered list of its identifiers, some bytes for a long text, and only these lists are grouped.

Nulls count as empty texts, and all empty texts are equal. A null ``doc_id`` sorts before all others. Rows that repeat
a ``doc_id`` are decided alike. Other columns of the input are not read. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import drop_rows, text_or_empty, with_group_totals, without_white_space
from strandline.sources.shared import stored

#: A chunk ends with a sentence, after 200 characters at least and 2,000 at most.
CHUNK = r"(?s).{199,1999}?[.!?;:\x{3002}\x{ff01}\x{ff1f}]|.{1,2000}"
MAX_LISTED = 10_000


def chunks(text: Column) -> Column:
    """The chunks in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def ambiguous_ids(documents: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk: every distinct chunk is compared by its content."""
    pieces = documents.select(F.explode(chunks(without_white_space(text_or_empty()))).alias("chunk"))
    distinct = pieces.select(F.xxhash64("chunk").alias("id"), "chunk").distinct()
    return distinct.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def recipes(documents: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, n_points, text_sha256, recipe) and ``more`` columns: the ordered verified identifiers of a text's chunks.

    An identifier shared by several chunks is replaced by the chunk's SHA-256, beyond ``MAX_LISTED`` of those all are.
    """
    listed = [row[0] for row in ambiguous_ids(documents).limit(MAX_LISTED + 1).collect()]
    norm = documents.select(
        "doc_id", F.length(text_or_empty()).alias("n_points"), without_white_space(text_or_empty()).alias("norm"), *more
    )

    def identifier(chunk: Column) -> Column:
        short, long = F.xxhash64(chunk), F.sha2(chunk, 256)
        if not listed:
            return short
        if len(listed) > MAX_LISTED:
            return long
        return F.when(short.isin(listed), long).otherwise(short.cast("string"))

    return norm.select(
        "doc_id",
        "n_points",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm")), identifier).alias("recipe"),
        *[name for name in norm.columns if name not in ("doc_id", "n_points", "norm")],
    )


def exact_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of (doc_id, text).

    Of equal texts the row with the most code points stays, then the one with the smallest ``doc_id``.
    """
    rows = stored(recipes(documents), "recipes")
    best = F.min(F.struct((-F.col("n_points")).alias("less"), "doc_id"))
    totals = {"best": (best, F.min), "group_size": (F.count("*"), F.sum)}
    grouped = with_group_totals(rows, ["recipe"], ["doc_id"], totals)
    return grouped.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each group, with all columns: the one that stays by ``exact_groups``, and of several such one.

    Rows are told apart by ``doc_id`` and the digest of the text as it is, so rows that share an id are decided each
    for their own text.
    """
    mark = F.sha2(text_or_empty(), 256)
    rows = stored(recipes(documents, mark.alias("mark")), "recipes")
    best = F.min(F.struct((-F.col("n_points")).alias("less"), "doc_id", "mark"))
    grouped = with_group_totals(rows, ["recipe"], ["doc_id", "mark"], {"best": (best, F.min)})
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark"))
    return drop_rows(documents, mark, grouped.filter(~stays).select("doc_id", "mark"))
