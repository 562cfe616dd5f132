"""Text clean-up and word lists."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from strandline.constants import NOT_A_LETTER, WIDTH

#: What ``(?U)\s`` of Java stands for, but the space.
_OTHER_SPACE = r"\t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: White space that is not a single space: hardly any of it is replaced.
_NOT_ONE_SPACE = f" [ {_OTHER_SPACE}]+|[{_OTHER_SPACE}][ {_OTHER_SPACE}]*"


def clean_event(text) -> Column:
    """Drop spaces, then turn all but Hangul, digits and Latin letters into '_'."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), NOT_A_LETTER, "_")


def strip_underscores(text) -> Column:
    return F.replace(text, F.lit("_"), F.lit(""))


def vocabulary_text(text) -> Column:
    """An event text as vocabularies know it: cleaned, without the marks that stand for other characters."""
    return strip_underscores(clean_event(text))


def words(text) -> Column:
    """Words between single spaces, empty ones left out."""
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def last_words(text, n: int = WIDTH) -> Column:
    """The text cut to its last n words."""
    return F.array_join(last_items(words(text), n), " ")


def last_items(items: Column, n) -> Column:
    """The last n entries of an array; shorter arrays stay whole."""
    n = F.lit(n) if isinstance(n, int) else n
    start = F.greatest(F.lit(1), F.size(items) - n + 1)
    return F.slice(items, start, F.greatest(n, F.lit(0)))


def spaced(text) -> Column:
    """Words between white space of any kind, joined by single spaces."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def spaced_texts(texts: pa.Array) -> pa.Array:
    """``spaced`` of an Arrow array."""
    return pc.ascii_trim(pc.replace_substring_regex(texts, _NOT_ONE_SPACE, " "), " ")


def text_slices(texts: pa.Array, slice_bytes: int) -> list[pa.Array]:
    """The array in stretches of some ``slice_bytes`` of text; a longer text comes alone."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // slice_bytes)) + 1).tolist(), len(texts)]
    return [texts[a:b] for a, b in zip(cuts, cuts[1:])]


def spaced_words(text) -> Column:
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")
