"""Web pages as trees of block elements with their texts in page order."""

import html
import re
from dataclasses import dataclass, field

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg math object select".split())
#: Of these, elements that can close themselves, and those that are ordinary elements where they have no end tag.
FOREIGN = frozenset({"svg", "math"})
ENDED = frozenset({"object", "select"})
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span"
    " strike strong sub sup time tt u var wbr br img".split()
)
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
#: An open element of the key is closed by the start of one of the values.
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
        " h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dt dd tr td th".split()
    ),
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "thead": frozenset({"tbody", "tfoot"}),
    "tbody": frozenset({"tbody", "tfoot"}),
    **dict.fromkeys(HEADINGS, HEADINGS),
}
#: What an implied end does not reach through.
SCOPES = {
    "li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}),
    "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"}),
}
_WALLS = frozenset({"table", "td", "th", "html", "body", "article", "section", "main"})

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s>/]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Node:
    """A block element. ``texts`` counts the characters of its blocks, ``links`` those of them inside links."""

    tag: str
    parent: int
    attributes: dict[str, str] = field(default_factory=dict)
    own_chars: int = 0
    chars: int = 0
    links: int = 0


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents before children, and (node, text) of each block in page order.

    A block is text between two borders of block elements; its white space is single spaces. The first node is the root.
    """
    nodes, blocks = [Node("#root", -1)], []
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; an inline one has the node of its block
    pieces: list[str] = []
    links = [0, 0]  # open links, and characters inside links in this block

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                node = stack[-1][1]
                blocks.append((node, text))
                nodes[node].own_chars += len(text)
                nodes[node].chars += len(text)
                nodes[node].links += min(links[1], len(text))
            links[1] = 0

    def put(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if links[0]:
                links[1] += len(text.strip())

    def close(depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        if any(tag not in INLINE for tag, _ in stack[depth:]):
            flush()
        links[0] -= sum(tag == "a" for tag, _ in stack[depth:])
        del stack[depth:]

    at = 0
    while True:
        match = _TOKEN.search(page, at)
        if not match:
            break
        put(page[at : match.start()])
        at = match.end()
        if match["end"]:
            tag = match["end"].lower()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag or tag in HEADINGS and stack[depth][0] in HEADINGS:
                    close(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE or tag == "p" and stack[depth][0] in _WALLS:
                    break
        elif match["start"]:
            tag, rest = match["start"].lower(), match["rest"]
            if tag in FOREIGN and rest.rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s>/]", re.IGNORECASE).search(page, at)
                if end or tag not in ENDED:
                    at = len(page) if not end else end.start()
                    continue
            if tag == "br":
                put(" ")
            if tag in INLINE or tag in VOID:
                if tag not in VOID:
                    if tag == "a":
                        links[0] += 1
                    stack.append((tag, stack[-1][1]))
                elif tag not in INLINE:
                    flush()
                continue
            for depth in range(len(stack) - 1, 0, -1):
                name = stack[depth][0]
                if tag in CLOSED_BY.get(name, ()):
                    close(depth)
                    break
                if tag in SCOPES and name in SCOPES[tag] or name in _WALLS and tag not in CLOSED_BY.get("td", ()):
                    break
            flush()
            nodes.append(Node(tag, stack[-1][1], attributes(rest)))
            stack.append((tag, len(nodes) - 1))
    put(page[at:])
    close(1)
    flush()
    for node in reversed(nodes[1:]):
        nodes[node.parent].chars += node.chars
        nodes[node.parent].links += node.links
    return nodes, blocks
