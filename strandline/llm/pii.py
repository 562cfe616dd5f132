"""Personal data in texts, disguised or not, with the place of each find in the source.

Base finds are what four patterns match in the text as it is. For disguised ones two transducers rewrite the text one
after the other: the first makes look-alike characters ASCII, the second reads its result and makes runs of spelled
digits digits, and at/dot disguises ``@`` and ``.``; so a disguise inside a disguise is undone too. Every rewritten piece
remembers which characters it stands for, so a match in the last text is mapped back through both to the source. A
mapped match is added unless a find of its kind already lies there.

Offsets are code points, ends exclusive. A null text counts as empty and has no finds. Rows that repeat a ``doc_id``
give a row each, null ids too. Only ``doc_id`` and ``text`` are read. An empty table gives an empty result.
"""

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, ``@`` and dotted domain, found from each ``@``: linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at - _run_before(text, at, free)
        domain = start < at and _DOMAIN.match(text, at + 1)
        if domain:
            yield "email", start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _run_before(text: str, end: int, floor: int, block: int = 64) -> int:
    """How many characters of a local part stand before ``end``."""
    length = 0
    while end - length > floor:
        part = text[max(floor, end - length - block) : end - length]
        found = _LOCAL_BACKWARDS.match(part[::-1])
        got = found.end() if found else 0
        length += got
        if got < len(part):
            break
        block *= 2
    return length


def addresses(text: str) -> Iterator[Span]:
    """Four numbers up to 255 with dots. In a longer row of numbers each four are one match."""
    for row in _NUMBERS.finditer(text):
        if row[0].count(".") < 3:
            continue
        for match in _DOTTED.finditer(text, row.start(), row.end()):
            if all(len(n := part.lstrip("0")) < 4 and int(n or 0) <= 255 for part in match[0].split(".")):
                yield "ip", *match.span()


def cards(text: str) -> Iterator[Span]:
    for match in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", match[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", *match.span()


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(int(d) for d in digits[::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def phones(text: str) -> Iterator[Span]:
    for match in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", match[0])) <= 15:
            yield "phone", *match.span()


def base_spans(text: str) -> list[Span]:
    """Kind by kind in the order of ``KINDS``, then by start."""
    return [span for find in (emails, addresses, cards, phones) for span in find(text)]


# Spelled digits in four languages, words and signs for @ and dot, look-alikes of ASCII characters.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "point", "punkt", "punto")
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t",
    "υ": "u", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    "․": ".", "。": ".", "・": ".", "·": ".", "﹒": ".", "﹫": "@", "⁺": "+", "﹢": "+", "\u00a0": " ", "\u2007": " ",
    "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Decimal digits of other scripts, by the first of their ten: Arabic, Persian, Devanagari, bold, double-struck.
DIGIT_ZEROS = (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)

_ONE = LOOK_ALIKES | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_ONE |= {chr(zero + d): str(d) for zero in DIGIT_ZEROS for d in range(10)} | dict.fromkeys(INVISIBLE, "")
_ONE |= {c: str(d) for d, c in enumerate("⓪①②③④⑤⑥⑦⑧⑨")}


def _any(words) -> str:
    return "|".join(map(re.escape, sorted(words, key=len, reverse=True)))


_SPACES = r"[\x20\t_]{1,3}"
_DIGIT_WORD = rf"(?:{_any(SPELLED)})"
_DOT_PLAIN = rf"{_SPACES}(?:{_any(DOT_WORDS)}){_SPACES}"
_JOINT = rf"(?:{_DOT_PLAIN}|[\x20\t]?[-,.]?[\x20\t]?)"
_DOT_BRACKET = rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:\.|{_any(DOT_WORDS)})\s{{0,3}}[\])}}>]"
_ONE_OF = re.compile(f"[{re.escape(''.join(_ONE))}]")
_SPECIAL = frozenset(_ONE)
_AT = (
    re.compile(rf"[\[({{<]\s{{0,3}}(?:@|{_any(AT_WORDS)})\s{{0,3}}[\])}}>]", re.IGNORECASE),
    re.compile(rf"(?:{_SPACES}|@)(?:{_any(AT_WORDS)}|@|{_SPACES}){_SPACES}?(?=[\w-]+(?:\.\w|{_DOT_PLAIN}|{_DOT_BRACKET}))", re.IGNORECASE),
)
_DOT = (
    re.compile(rf"[\[({{<]\s{{0,3}}(?:\.|{_any(DOT_WORDS)})\s{{0,3}}[\])}}>]", re.IGNORECASE),
    re.compile(rf"{_DOT_PLAIN}(?=\w)", re.IGNORECASE),
)
_OPEN_DOT = re.compile(r"[\[({<]\s{0,3}\.")
#: Digits and spelled digits in a row, with a spelled one among them.
_SPELLED = re.compile(
    rf"\b(?:[0-9]{_JOINT})*+{_DIGIT_WORD}\b(?:{_JOINT}(?:{_DIGIT_WORD}\b|[0-9]))+", re.IGNORECASE
)
_DIGIT_TOKEN = re.compile(rf"{_DIGIT_WORD}|[0-9]|[-.]|{_any(DOT_WORDS)}", re.IGNORECASE)
_AS_DIGIT = SPELLED | dict.fromkeys(DOT_WORDS, ".")
_PLUS = re.compile(rf"\bplus[\x20\t](?=[0-9]|{_DIGIT_WORD}\b)", re.IGNORECASE)
_PLAIN_AT = re.compile(rf"^(\w+){_SPACES}(?:{_any(AT_WORDS)}){_SPACES}[\w.-]+$", re.IGNORECASE)


def character_edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of look-alikes, in order; texts without any are told by a cheap search."""
    if text.isascii() or _SPECIAL.isdisjoint(text):
        return []
    return [(*m.span(), _ONE[m[0]]) for m in _ONE_OF.finditer(text)]


def word_edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of words and signs that stand for others, in order and without overlaps.

    Whether a text has anything of a kind is asked first, by searches that are cheap for the many that have not.
    """
    found: list[tuple[int, int, str]] = []
    lower = text.lower()
    if "@" in text or any(word in lower for word in AT_WORDS):
        found += [_with_spaces(text, m, "@") for m in _AT[0].finditer(text)]
        found += [(*m.span(), "@") for m in _AT[1].finditer(text) if "@" in m[0] or not m[0].isspace()]
    dot_words = any(word in lower for word in DOT_WORDS)
    if dot_words or _OPEN_DOT.search(text):
        found += [_with_spaces(text, m, ".") for m in _DOT[0].finditer(text)]
    if dot_words:
        found += [(*m.span(), ".") for m in _DOT[1].finditer(text)]
    if not SPELLED.keys().isdisjoint(lower.replace("-", " ").replace(",", " ").replace(".", " ").split()):
        for m in _SPELLED.finditer(text):
            tokens = list(_DIGIT_TOKEN.finditer(m[0]))
            ends = [t.start() for t in tokens[1:]] + [len(m[0])]
            found += [
                (m.start() + t.start(), m.start() + t.end(), _AS_DIGIT.get(t[0].lower(), t[0])) for t in tokens
            ]
            found += [(m.start() + t.end(), m.start() + e, "") for t, e in zip(tokens, ends) if t.end() < e]
    if "plus" in lower:
        found += [(*m.span(), "+") for m in _PLUS.finditer(text)]
    kept, done = [], 0
    for edit in sorted(found):
        if edit[0] >= done:
            kept.append(edit)
            done = edit[1]
    return kept


def _with_spaces(text: str, match: re.Match, sign: str) -> tuple[int, int, str]:
    """A bracketed sign stands for up to three spaces on either side too."""
    start, end = match.span()
    start -= len(before := text[max(0, start - 3) : start]) - len(before.rstrip())
    end += len(after := text[end : end + 3]) - len(after.lstrip())
    return start, end, sign


class Rewritten:
    """A text after a transducer, and where its characters come from; ``earlier`` is the step that gave the text."""

    def __init__(self, text: str, changes: list[tuple[int, int, str]], earlier: "Rewritten | None" = None):
        self.read, self.earlier = text, earlier
        out: list[str] = []
        #: Pieces by start in the result: (start in the result, start and end in the source, copied as it is).
        self.pieces: list[tuple[int, int, int, bool]] = []
        done = length = 0

        def put(piece: str, start: int, end: int, same: bool) -> None:
            nonlocal length
            if piece:
                self.pieces.append((length, start, end, same))
                out.append(piece)
                length += len(piece)

        for start, end, piece in changes:
            put(text[done:start], done, start, True)
            put(piece, start, end, False)
            done = end
        put(text[done:], done, len(text), True)
        self.text = "".join(out)
        self._starts = [piece[0] for piece in self.pieces]

    def _span(self, start: int, end: int) -> tuple[int, int]:
        """The characters of the text that was read that the result's characters from ``start`` to ``end`` stand for."""
        at, source, stop, same = self.pieces[bisect_right(self._starts, start) - 1]
        first = source + start - at if same else source
        at, source, stop, same = self.pieces[bisect_right(self._starts, end - 1) - 1]
        return first, source + end - at if same else stop

    def before(self, start: int, end: int) -> str:
        """What was read in place of these characters."""
        first, last = self._span(start, end)
        return self.read[first:last]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The characters of the source, through all steps."""
        span = self._span(start, end)
        return self.earlier.source(*span) if self.earlier else span


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Finds in the rewritten text, mapped back, that touch no base find of their kind."""
    in_characters = character_edits(text)
    plain_text = Rewritten(text, in_characters) if in_characters else None
    in_words = word_edits(plain_text.text if plain_text else text)
    if not in_characters and not in_words:
        return []
    rewritten = Rewritten(plain_text.text, in_words, plain_text) if plain_text else Rewritten(text, in_words)
    taken = {kind: sorted(span[1:] for span in base if span[0] == kind) for kind in KINDS}
    added = []
    for kind, start, end in base_spans(rewritten.text):
        first, last = rewritten.source(start, end)
        at = bisect_right(taken[kind], (first, last))
        near = taken[kind][max(0, at - 1) : at + 1]
        if any(a < last and first < b for a, b in near) or text[first:last] == rewritten.text[start:end]:
            continue
        plain = _PLAIN_AT.match(rewritten.before(start, end))
        if plain and plain[1].isalpha():  # a name at a site, not an address: "seen at example.com"
            continue
        if kind == "email" and rewritten.text[start:end].rpartition(".")[2].isdigit():  # "5 at 3.2"
            continue
        added.append((kind, first, last))
    return added


def written(spans: list[Span]) -> str:
    order = {kind: n for n, kind in enumerate(KINDS)}
    spans = sorted(spans, key=lambda span: (order[span[0]], span[1], span[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{kind}", pa.int64()) for kind in KINDS], ("base", pa.string()), ("spans", pa.string())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            base = base_spans(text or "")
            kinds = [span[0] for span in base]
            found = {f"n_{kind}": kinds.count(kind) for kind in KINDS}
            spans = base + added_spans(text or "", base)
            rows.append({"doc_id": doc_id, **found, "base": written(base), "spans": written(spans)})
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): counts and list of base finds, list of all finds.

    Lists are ``kind:start:end`` by kind, then start, joined by commas. One pass, nothing is shuffled.
    """
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(
        _find, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"
    )


def mask(text: str, spans: list[Span]) -> str:
    """The text with every find replaced by its kind in brackets; of overlapping finds the first counts."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda span: (span[1], -span[2])):
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
            done = end
    return "".join([*out, text[done:]])


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
