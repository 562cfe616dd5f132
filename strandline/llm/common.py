"""What several corpus operators need: white space, hot groups, connected components."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strandline.operators.ordering import broadcast_if_small
from strandline.sources.shared import stored

#: [\x20\x09-\x0D]
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Links whose nodes, two each at most, are told to all tasks.
FEW_LINKS = 100_000

_SALT = "__salt"
_MARK = "__mark"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def without_white_space(text: Column) -> Column:
    """Byte searches, one per character: cheaper than one pass of a regular expression."""
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def with_group_totals(
    rows: DataFrame, keys: Sequence[str], spread_by: Sequence[str], totals: dict[str, tuple[Column, object]], salts: int = 64
) -> DataFrame:
    """Rows with totals of their group, however large the group is.

    ``totals``: result -> (aggregate of rows, function that combines a column of such aggregates). A group is cut into
    ``salts`` pieces by a hash of ``spread_by``: pieces are combined before they meet, and every row finds its total by
    its piece, so that no task holds a whole group. Keys must not be null; ``rows`` is read twice, store it before.
    """
    salted = rows.withColumn(_SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    pieces = salted.groupBy(*keys, _SALT).agg(*[first.alias(name) for name, (first, _) in totals.items()])
    whole = pieces.groupBy(*keys).agg(*[again(F.col(name)).alias(name) for name, (_, again) in totals.items()])
    by_piece = pieces.select(*keys, _SALT).join(whole, list(keys))
    return salted.join(by_piece, [*keys, _SALT]).drop(_SALT)


def drop_rows(documents: DataFrame, mark: Column, lost: DataFrame) -> DataFrame:
    """The documents without the rows of (doc_id, mark), null ids included; of rows that agree in both one stays.

    ``mark`` tells texts apart, so a row goes only for its own text and never for a ``doc_id`` that others have too.
    """
    columns = documents.columns
    marked = documents.withColumn(_MARK, mark)
    left = _without(marked, stored(lost.distinct(), "lost-rows"))
    again = marked.groupBy("doc_id", _MARK).agg(F.count("*").alias("n")).filter("n > 1")
    again = stored(again.select("doc_id", F.col(_MARK).alias("mark")), "repeated-rows")
    if again.isEmpty():
        return left.select(columns)
    same = again.withColumnRenamed("doc_id", "__doc_id")
    found = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col(_MARK) == F.col("mark"))
    copies = left.join(same, found, "left_semi")
    row = F.struct(*columns)  # columns may be of kinds that have no order, such as maps
    one = copies.groupBy("doc_id", _MARK).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return _without(left, again).select(columns).unionByName(one)


def _without(marked: DataFrame, lost: DataFrame) -> DataFrame:
    """Texts stay where they are, unless too many rows are lost to be known everywhere."""
    lost = broadcast_if_small(lost.withColumnRenamed("doc_id", "__doc_id"))
    found = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col(_MARK) == F.col("mark"))
    return marked.join(lost, found, "left_anti")


def components(links: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node in a link.

    Alternating large and small stars: each round hangs neighbours on smaller ones until only stars are left, in
    logarithmically many rounds. Rounds are stored, so a lost executor costs one round.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges, before = stored(pairs, "links"), None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v")
            ).distinct()
        before = now
        both, few = edges.union(edges.select("v", "u")), now[0] <= FEW_LINKS
        large = _with_smallest(both, few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large-stars")
        small = _with_smallest(large, few)
        hung = small.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = stored(hung.distinct(), "small-stars")
    raise RuntimeError(f"no components after {max_rounds} rounds")


def _with_smallest(edges: DataFrame, few: bool) -> DataFrame:
    """Edges with the smallest node, ``m``, that ``u`` or a neighbour is. Few are told to all tasks: half the shuffles of many."""
    smallest = F.min(F.least("u", "v"))
    if few:
        return edges.join(F.broadcast(edges.groupBy("u").agg(smallest.alias("m"))), "u")
    return with_group_totals(edges, ["u"], ["v"], {"m": (smallest, F.min)})
