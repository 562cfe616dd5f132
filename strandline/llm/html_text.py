"""Main text of web pages by a graphical model on the tree of their elements.

Every block element is content or not. The words of its class, id and role, and by its kind the length of its text and
the part of it inside links speak for either; a potential between parent and child says, by the child's tag and whether it is named, how
often content lies in content and how often it begins or ends there: at a division more than at a paragraph.
Messages pass from the leaves to the root and back (sum-product), which gives each element's exact marginal, and the
blocks of elements more likely content than not are the text. All potentials are counted on labelled pages. A short text
in unnamed elements has little that speaks for it, so where no block is likely, the page is taken to have some content:
the blocks that then are more likely content than not are the text, by the same marginals divided by the probability
that not all elements are without content. If that favours no block either, the text is empty.

A null or empty page has an empty text, and so has one without content. Rows that repeat a ``page_id`` give a row each,
null ids too; a null URL stays null. Other columns are not read. An empty table gives an empty result.
"""

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm.dom import Node, parse
from strandline.llm.labelled_pages import LABEL, labelled_pages

# Words in class, id and role that say what a part is for.
HINTS = frozenset(
    "ad ads adslot advert advertisement alert article banner body bottom box breadcrumb caption comment comments consent"
    " container content cookie copyright disclaimer discussion disqus entry footer form header infobar links login main"
    " maintext masthead menu meta modal nav navbar navigation newsletter notice overlay page pager pagination popup post"
    " promo promoted recommended related reply replies row search share sidebar signup site social sponsor sponsored"
    " story subscribe tags teaser text toolbar top user widget alert complementary lead wrapper".split()
)
#: Elements that begin a part of a page rather than a block of text.
CONTAINERS = frozenset("article aside div footer form header main nav ol section table td ul".split())
#: Below this the probability that a page has content at all is lost in rounding: the text is empty.
LEAST_CHANCE = 1e-6
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[a-z]+")
_LENGTHS = (0, 10, 25, 60, 120, 300)
_SHARES = (0.0, 0.1, 0.3, 0.6, 0.95)


def hints(node: Node) -> set[str]:
    names = " ".join(node.attributes.get(key, "") for key in ("class", "id", "role", "itemprop"))
    found = set(_NAME.findall(_CAMEL.sub(" ", names).lower())) & HINTS if names else set()
    if "hidden" in node.attributes or "display:none" in node.attributes.get("style", "").replace(" ", "").lower():
        found.add("hidden")
    return found


def border(node: Node) -> str:
    """What the potential to the parent depends on: the tag, and whether the names say something."""
    return node.tag + "*" * bool(hints(node))


def features(node: Node) -> list[str]:
    kind = node.tag if node.tag in CONTAINERS or node.tag in ("p", "li") else "text"
    share = node.links / node.chars if node.chars else 0.0
    return [
        f"own.{kind}={sum(node.own_chars > limit for limit in _LENGTHS)}",
        f"links.{kind}={sum(share > limit for limit in _SHARES) if node.chars else 'none'}",
        *[f"name={hint}" for hint in hints(node)],
    ]


@dataclass
class Model:
    """Logarithms of potentials for (not content, content)."""

    node: dict[str, tuple[float, float]]
    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]  # by the child's border, "" for any other
    child: dict[str, tuple[float, float]]  # how often content and the rest have such a child
    root: tuple[float, float] = (0.0, -12.0)

    def potential(self, node: Node) -> tuple[float, float]:
        known = [self.node[f] for f in features(node) if f in self.node]
        return sum(p[0] for p in known), sum(p[1] for p in known)

    def between(self, node: Node, alike: int) -> tuple[tuple[float, float], tuple[float, float]]:
        """Of the labels of the parent and the node, which has ``alike`` siblings of its kind, itself included."""
        kind = border(node)
        (a, b), (c, d) = self.edge.get(kind, self.edge[""])
        no, yes = self.child.get(kind, (0.0, 0.0))
        return (a + no / alike, b + no / alike), (c + yes / alike, d + yes / alike)


def _kin(node: Node) -> tuple:
    """Siblings of one tag and class repeat one another: together they speak with the weight of one."""
    return node.parent, node.tag, node.attributes.get("class"), node.attributes.get("id")


def _log_sum(a: float, b: float) -> float:
    high = a if a > b else b
    return high + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: Sequence[Node], model: Model) -> list[float]:
    """The probability of content for every node; parents stand before their children."""
    return marginals_and_some(nodes, model)[0]


def marginals_and_some(nodes: Sequence[Node], model: Model) -> tuple[list[float], float]:
    """The probability of content for every node, and that any node has content."""
    alike = Counter(map(_kin, nodes))
    own = [list(model.root)]
    for node in nodes[1:]:
        no, yes = model.potential(node)
        own.append([no / alike[_kin(node)], yes / alike[_kin(node)]])
    upward = [(0.0, 0.0)] * len(nodes)  # what a node tells its parent
    edges = [model.between(node, alike[_kin(node)]) for node in nodes]
    no_content = sum(no for no, _ in own) + sum(edge[0][0] for edge in edges[1:])
    for i in range(len(nodes) - 1, 0, -1):
        (e00, e01), (e10, e11) = edges[i]
        no, yes = own[i]
        upward[i] = _log_sum(no + e00, yes + e01), _log_sum(no + e10, yes + e11)
        above = own[nodes[i].parent]
        above[0] += upward[i][0]
        above[1] += upward[i][1]
    some = -math.expm1(min(0.0, no_content - _log_sum(*own[0])))
    for i in range(1, len(nodes)):  # own now holds all evidence from below; add that from above
        no, yes = own[nodes[i].parent]
        no, yes = no - upward[i][0], yes - upward[i][1]
        (e00, e01), (e10, e11) = edges[i]
        down = _log_sum(no + e00, yes + e10), _log_sum(no + e01, yes + e11)
        high = max(down)
        own[i][0] += down[0] - high
        own[i][1] += down[1] - high
    return [1 / (1 + math.exp(min(700.0, max(-700.0, no - yes)))) for no, yes in own], some


def _counts(page: str) -> Counter:
    nodes, _ = parse(page)
    labels, found = [0], Counter()
    for node in nodes[1:]:
        labels.append(int(node.attributes.get(LABEL, labels[node.parent])))
        for feature in features(node):
            found[feature, labels[-1]] += 1
        for tag in (border(node), ""):
            found[f"edge={labels[node.parent]}{tag}", labels[-1]] += 1
    return found


def train(labelled: DataFrame, smoothing: float = 0.5) -> Model:
    """Potentials from a frame (html) of labelled pages: how often each feature and each pair of labels was met.

    As many rows reach the driver as there are features, which are a fixed set but for the names of elements.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = sum(map(_counts, frame["html"].dropna()), Counter())
            yield pd.DataFrame([(f, label, n) for (f, label), n in found.items()], columns=["feature", "label", "n"])

    counted = labelled.select("html").mapInPandas(count, "feature string, label int, n bigint")
    table: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for feature, label, n in counted.groupBy("feature", "label").agg(F.sum("n")).collect():
        table[feature][label] = n

    def logs(numbers: list[float], wholes: list[float], kinds: int = 2) -> tuple[float, float]:
        return tuple(math.log((n + smoothing) / (whole + kinds * smoothing)) for n, whole in zip(numbers, wholes))

    edge, child = {}, {}
    children = [sum(table[f"edge={label}"]) for label in (0, 1)]
    for tag in {feature[6:] for feature in table if feature.startswith("edge=")}:
        pairs = [table[f"edge={label}{tag}"] for label in (0, 1)]
        edge[tag] = tuple(logs(row, [sum(row)] * 2) for row in pairs)
        child[tag] = logs([sum(row) for row in pairs], children)
    child.pop("")
    groups: dict[str, list[str]] = defaultdict(list)
    for feature in table:
        groups[feature.partition("=")[0]].append(feature)
    node = {}
    for group in groups.keys() - {"edge"}:
        wholes = [sum(column) for column in zip(*[table[feature] for feature in groups[group]])]
        node |= {feature: logs(table[feature], wholes, len(groups[group])) for feature in groups[group]}
    return Model(node, edge, child)


def default_model(spark: SparkSession) -> Model:
    """Trained on the labelled pages of the library."""
    return train(spark.createDataFrame([(page,) for page in labelled_pages()], "html string"))


def main_text(page: str | None, model: Model) -> str:
    """The blocks of content, one a line."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    content, some = marginals_and_some(nodes, model)
    likely = [text for node, text in blocks if content[node] > 0.5]
    if not likely and some > LEAST_CHANCE:
        likely = [text for node, text in blocks if content[node] > 0.5 * some]
    return "\n".join(likely)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text) of every row of (page_id, url, html). Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page, model) for page in batch["html"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], texts], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string")
