"""Mixes sources to target weights in a tree of domain, language and source.

Every node has a weight among its siblings and a capacity, the tokens below it times ``max_epochs``. A budget flows
from the root to the leaves; what a child cannot take goes to its siblings by their weights, and only a parent that is
full as a whole leaves tokens to its own siblings. All amounts are whole tokens; a split rounds down.

A leaf's documents stand in the order of an md5 of seed, epoch and ``doc_id``. It gives whole epochs as often as its
budget holds them, then a prefix of the next one, whose last document is cut.

A null level is a node of its own, named ``-``. Documents without tokens (null or empty texts) are never drawn. Rows
that repeat a ``doc_id`` are drawn each for itself. Columns of the input named like the results are not used.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.operators.ordering import broadcast_if_small
from strandline.sources.shared import stored

TOKEN = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the order that make a bucket: prefixes are found by bucket, then inside one.
BUCKET_DIGITS = 3
_WIDE = "decimal(38,0)"
_ROOT = "__root"


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def token_prefix(text: Column, tokens: Column) -> Column:
    """The first tokens, joined by single spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lit(1), tokens.cast("int")), " ")


def node_weight(column: str, weights: Mapping[str, int], default: int = 1) -> Column:
    if min([default, *weights.values()]) < 1:
        raise ValueError("weights are whole numbers from 1")
    found = F.lit(default)
    for node, weight in weights.items():
        found = F.when(F.col(column) == node, weight).otherwise(found)
    return found.cast("long")


def split_budget(nodes: DataFrame, parents: Sequence[str], node: str) -> DataFrame:
    """Adds ``share`` to (parents, node, capacity, weight, budget): its part of the parents' budget.

    Siblings fill up in the order of capacity by weight. One is full if an equal level for it and all later ones would
    exceed its capacity; the others split by weight what the full ones leave.
    """
    siblings = Window.partitionBy(*parents)
    filling = siblings.orderBy(F.col("capacity") / F.col("weight"), node)
    earlier = F.sum("capacity").over(filling.rowsBetween(Window.unboundedPreceding, -1))
    wide = lambda c: c.cast(_WIDE)
    left = nodes.withColumn("__left", F.col("budget") - F.coalesce(earlier, F.lit(0))).withColumn(
        "__weights", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    )
    full = left.withColumn(
        "__full", wide(F.col("capacity")) * F.col("__weights") <= wide(F.col("__left")) * F.col("weight")
    )
    rest = full.withColumn(
        "__rest", F.col("budget") - F.sum(F.when(F.col("__full"), F.col("capacity")).otherwise(0)).over(siblings)
    ).withColumn("__open", F.sum(F.when(F.col("__full"), 0).otherwise(F.col("weight"))).over(siblings))
    level = F.expr(f"cast(cast(__rest as {_WIDE}) * weight div __open as bigint)")
    return rest.withColumn("share", F.when(F.col("__full"), F.col("capacity")).otherwise(level)).drop(
        "__left", "__weights", "__full", "__rest", "__open"
    )


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int
) -> DataFrame:
    """(levels, tokens, budget) for (levels, tokens): the tokens to draw from each leaf.

    ``budget`` is an expression over ``total``, the tokens of all leaves.
    """
    leaves = leaves.withColumn(_ROOT, F.lit(0))
    whole = leaves.groupBy(_ROOT).agg(F.sum("tokens").alias("total"))
    plan = whole.select(_ROOT, F.least(budget, F.col("total") * max_epochs).alias("budget"))
    done = [_ROOT]
    for level in levels:
        below = leaves.groupBy(*done, level).agg((F.sum("tokens") * max_epochs).alias("capacity"))
        nodes = below.withColumn("weight", node_weight(level, weights.get(level, {}))).join(plan, done)
        plan = split_budget(nodes, done, level).select(*done, level, F.col("share").alias("budget"))
        done.append(level)
    return leaves.join(plan, done).drop(_ROOT)


def mix(
    documents: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    budget: Column,
    max_epochs: int = 2,
    seed: int = 0,
) -> DataFrame:
    """(doc_id, levels, n_tokens, epoch, take_tokens) of the documents to read.

    ``levels`` names the columns of the tree from its root and says how they come from a document.
    """
    names = list(levels)
    tree = [F.coalesce(column.cast("string"), F.lit("-")).alias(name) for name, column in levels.items()]
    counted = documents.select("doc_id", *tree, count_tokens(F.col("text")).alias("n_tokens")).filter("n_tokens > 0")
    rows = stored(counted, "token-counts")
    leaves = stored(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    budgets = leaf_budgets(leaves, names, weights, budget, max_epochs)
    plan = stored(
        budgets.select(
            *names, F.expr("cast(budget div tokens as int)").alias("whole"), F.expr("budget % tokens").alias("rest")
        ),
        "leaf-plan",
    )
    drawn = rows.join(broadcast_if_small(plan), names)
    kept = ["doc_id", *names, "n_tokens"]
    whole = drawn.filter("whole > 0").select(
        *kept, F.explode(F.expr("sequence(0, whole - 1)")).alias("epoch"), F.col("n_tokens").alias("take_tokens")
    )
    return whole.unionByName(_prefix(drawn.filter("rest > 0"), names, kept, seed))


def _prefix(rows: DataFrame, names: list[str], kept: list[str], seed: int) -> DataFrame:
    """The first ``rest`` tokens of each leaf in the order of epoch ``whole``.

    Sums by bucket show in which bucket the prefix ends; only rows of that one bucket are put in order.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.col("doc_id").cast("string")))
    rows = rows.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    sums = rows.groupBy(*names, "rest", "__bucket").agg(F.sum("n_tokens").alias("__n"))
    before = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__n").over(before), F.lit(0))
    last = sums.withColumn("__start", start).filter("__start < rest and __start + __n >= rest")
    ends = stored(last.select(*names, F.col("__bucket").alias("__last"), "__start"), "prefix-ends")
    rows = rows.join(broadcast_if_small(ends), names)
    inside = Window.partitionBy(*names).orderBy("__key", "doc_id", "n_tokens")
    earlier = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    epoch = F.col("whole").alias("epoch")
    early = rows.filter("__bucket < __last").select(*kept, epoch, F.col("n_tokens").alias("take_tokens"))
    cut = rows.filter("__bucket = __last").withColumn("__free", F.col("rest") - F.col("__start") - earlier)
    return early.unionByName(
        cut.filter("__free > 0").select(*kept, epoch, F.least("n_tokens", "__free").alias("take_tokens"))
    )
