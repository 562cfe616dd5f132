"""Toxicity by a weighted lexicon, learned from labelled rows and matched by Aho-Corasick on folded text.

Folding undoes disguises: case, invisible characters, look-alike letters, digits and signs in place of letters. The
lexicon holds words and word beginnings that are much more common in toxic texts; phrases around a term that clean
texts use are exceptions, and a match inside one doesn't count. The score is a logistic function of the matched
weights, in total and by length.

A null or empty text has no match and gets the score of such a text. Rows that repeat a ``doc_id`` are scored each for
itself; a null ``doc_id`` is scored and never learned from. Labels that are null are not used, of several labels of a
document the largest counts, and of texts that share a ``doc_id`` the least is learned from. Only ``doc_id`` and
``text`` are read from the documents. An empty table gives an empty result. Without labelled texts of both kinds nothing
can be told apart: the lexicon is empty, and every text gets the same score, below one half. What is learned depends
on the rows alone, not on how they are partitioned.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows to learn from at most: those with the smallest hashes of their ``doc_id``.
TRAIN_ROWS = 12_000
#: A term's counts in toxic and clean texts differ by a log-likelihood ratio of so much: a chance of 1 in 10 million.
MIN_RATIO = 28.0
STEM_LETTERS = (4, 5, 6, 7)
#: A longer term that stands in this part of the texts of a shorter one is the better name for them.
SAME_TEXTS = 0.9
DEFAULT_EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum")

# Letters that look like a Latin one, and signs written for a letter.
LOOK_ALIKES = {
    "а": "a", "α": "a", "ɑ": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ҽ": "e",
    "ɡ": "g", "һ": "h", "н": "h", "η": "n", "і": "i", "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "i",
    "ⅼ": "i", "м": "m", "μ": "m", "п": "n", "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r",
    "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ѵ": "v", "ν": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x",
    "у": "y", "γ": "y", "ʏ": "y", "ᴢ": "z",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_FULL_WIDTH = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_RARE = LOOK_ALIKES | dict.fromkeys(INVISIBLE, "")
_SPECIAL = frozenset(_RARE | _FULL_WIDTH)
_WIDTH, _RARE = str.maketrans(_FULL_WIDTH), str.maketrans(_RARE)
_SIGN = re.compile(r"[!|+€@$](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_TO_LETTERS = str.maketrans(DIGITS)


def fold(text: str) -> str:
    """Folded words, single spaces between them and one at either end. Numbers without a letter stay as they are."""
    text = text.lower()
    if not text.isascii() and not _SPECIAL.isdisjoint(text):
        text = text.translate(_WIDTH).lower().translate(_RARE)
    if any(sign in text for sign in SIGNS):
        text = _SIGN.sub(_sign_as_letter, text)
    words = _WORD.findall(text)
    return f" {' '.join([word if word.isalpha() else _digits_as_letters(word) for word in words])} "


def _sign_as_letter(match: re.Match) -> str:
    """``@`` and ``$`` may begin a word, the others stand inside one."""
    sign, start = match[0], match.start()
    inside = start > 0 and match.string[start - 1].isalnum()
    return SIGNS[sign] if inside or sign in "@$" else sign


def _digits_as_letters(word: str) -> str:
    return word if word.isdigit() else word.translate(_TO_LETTERS)


@dataclass
class Lexicon:
    """Weights by pattern: ``" word "`` or, for a word beginning, ``" stem"``; phrases that excuse what they hold."""

    weights: dict[str, float]
    exceptions: Sequence[str] = field(default_factory=tuple)
    coefficients: tuple[float, float, float] = (-4.0, 2.0, 10.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        alike: dict[str, list[tuple[str, float | None]]] = defaultdict(list)
        for term, weight in [*self.weights.items(), *((phrase, None) for phrase in self.exceptions)]:
            alike[_i_for_l(term)].append((term, weight))
        for pattern, terms in alike.items():
            found.add_word(pattern, terms)
        found.make_automaton()
        return found


def _i_for_l(text: str) -> str:
    return text.replace("l", "i")


def _written_as(term: str, seen: str) -> bool:
    """Whether ``seen`` is the term with i, what 1 and | are folded to, for some of its l."""
    return all(a == b or (a == "l" and b == "i") for a, b in zip(term, seen))


def matches(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the strongest match that starts at a word and isn't inside an exception."""
    hits: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    for last, terms in automaton.iter(_i_for_l(folded)) if len(automaton) else ():
        end = last + 1
        start = end - len(terms[0][0])
        seen = folded[start:end]
        excused += [(start, end) for phrase, weight in terms if weight is None and phrase == seen]
        weights = {term: weight for term, weight in terms if weight is not None and _written_as(term, seen)}
        weight = weights.get(seen, max(weights.values(), default=None))
        if weight is not None and (start not in hits or weight > hits[start][1]):
            hits[start] = (end, weight)
    return [
        (start, end, weight) for start, (end, weight) in sorted(hits.items())
        if not any(a <= start and end <= b for a, b in excused)
    ]


def features(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Matched weight as a logarithm, and by word."""
    total = sum(weight for _, _, weight in matches(folded, automaton))
    return float(np.log1p(total)), total / max(1, folded.count(" ") - 1)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for one fold in ``folds`` of the documents, by the CRC-32 of the id as text, and for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def training_texts(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic, part) of at most ``rows`` labelled documents outside the held-out fold.

    Of near copies, told by the smallest hash of their word triples, the one with the smallest ``doc_id`` is kept, or
    each of their words would look like a term. ``part`` 0 and 1 are for the lexicon, 2 for the coefficients.
    """
    known = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    pairs = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # one a document

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [fold(text) for text in frame["text"]]
            frame["sketch"] = [_sketch(text) for text in frame["text"]]
            yield frame

    folded = pairs.mapInPandas(sketch, "doc_id bigint, text string, toxic int, sketch bigint")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("part")
    first = folded.groupBy("toxic", "sketch").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    return first.select("toxic", "row.*").select("text", "toxic", part)


def _sketch(folded: str) -> int:
    words = folded.split()
    triples = zip(words, words[1:], words[2:]) if len(words) > 2 else [tuple(words)]
    return min(xxhash.xxh64_intdigest(" ".join(t)) for t in triples) >> 1


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many texts each word and word beginning stands."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: list[Counter] = [Counter(), Counter()]
            for text, toxic in zip(frame["text"], frame["toxic"]):
                words = set(text.split())
                terms = {f" {word} " for word in words}
                for n in STEM_LETTERS:
                    terms.update(f" {word[:n]}" for word in words if len(word) > n)
                seen[int(toxic > 0)].update(terms)
            both = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"term": both, "toxic": [seen[1][t] for t in both], "clean": [seen[0][t] for t in both]})

    counted = texts.select("text", "toxic").mapInPandas(count, "term string, toxic bigint, clean bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, exceptions=DEFAULT_EXCEPTIONS) -> Lexicon:
    """Lexicon, exceptions and coefficients from the labelled rows.

    What reaches the driver is bounded by ``rows``: the terms that pass the test, and three numbers a document.
    """
    texts = training_texts(documents, labels, rows).persist()
    sizes = {(part, toxic > 0): n for part, toxic, n in texts.groupBy("part", "toxic").count().collect()}
    toxic, clean = (sum(n for (part, kind), n in sizes.items() if part < 2 and kind == want) for want in (True, False))
    if not toxic or not clean:
        texts.unpersist()
        return Lexicon({})
    share, seen = toxic / (toxic + clean), F.col("toxic") + F.col("clean")
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    ratio = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / (seen * share))
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (seen * (1 - share)))).otherwise(0.0)
    )
    terms = (
        term_counts(texts.filter("part < 2")).filter(F.col("toxic") > seen * share)
        .withColumns({"weight": odds, "ratio": ratio}).filter(F.col("ratio") >= MIN_RATIO)
        .orderBy(F.desc("ratio"), F.length("term"), "term").collect()
    )
    lexicon = Lexicon(best_names({row["term"]: (row["weight"], row["toxic"]) for row in terms}))
    lexicon.exceptions = tuple(dict.fromkeys([*map(fold, exceptions), *_clean_phrases(texts, lexicon)]))
    automaton_of = lexicon.automaton

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = automaton_of()
        for frame in frames:
            rows = [(*features(text, automaton), float(t > 0)) for text, t in zip(frame["text"], frame["toxic"])]
            yield pd.DataFrame(rows, columns=["total", "rate", "toxic"])

    measured = texts.filter("part = 2").select("text", "toxic").mapInPandas(measure, "total double, rate double, toxic double")
    found = measured.toPandas().to_numpy()  # at most ``rows``; sorted, as sums of fractions hang on their order
    lexicon.coefficients = _logistic(found[np.lexsort(found.T)])
    texts.unpersist()
    return lexicon


def best_names(terms: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Weights of (weight, number of toxic texts): the longest term for the same texts, and none inside another's."""
    best = dict(terms)
    for term, (_, texts) in terms.items():
        for shorter in (term[:n] for n in range(STEM_LETTERS[0] + 1, len(term))):
            if shorter in terms and texts >= SAME_TEXTS * terms[shorter][1]:
                best.pop(shorter, None)
    return {
        term: weight for term, (weight, _) in best.items()
        if not any(term[:n] in best for n in range(STEM_LETTERS[0] + 1, len(term)))
    }


def _clean_phrases(texts: DataFrame, lexicon: Lexicon, least: int = 3) -> list[str]:
    """A term with the word before or after it, as several clean texts and no toxic one have it."""
    automaton_of = lexicon.automaton

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = automaton_of()
        for frame in frames:
            found = []
            for text, toxic in zip(frame["text"], frame["toxic"]):
                phrases = set()
                for start, end, _ in matches(text, automaton):
                    end = text.index(" ", max(end - 1, start + 1)) + 1
                    if start:
                        phrases.add(text[text.rindex(" ", 0, start) : end])
                    if end < len(text):
                        phrases.add(text[start : text.index(" ", end) + 1])
                found += [(phrase, int(toxic > 0)) for phrase in phrases]
            yield pd.DataFrame(found, columns=["phrase", "toxic"])

    counted = texts.select("text", "toxic").mapInPandas(pairs, "phrase string, toxic int").groupBy("phrase")
    often = counted.agg(F.max("toxic").alias("toxic"), F.count("*").alias("n")).filter(f"toxic = 0 and n >= {least}")
    return [row[0] for row in often.orderBy(F.desc("n"), "phrase").collect()]


def _logistic(rows: np.ndarray, steps: int = 50, ridge: float = 0.1) -> tuple[float, float, float]:
    """Newton's method; the ridge keeps separable rows finite."""
    if not len(rows) or rows[:, 2].min() == rows[:, 2].max():
        return Lexicon({}).coefficients
    x, y = np.column_stack([np.ones(len(rows)), rows[:, :2]]), rows[:, 2]
    w, penalty = np.zeros(3), np.diag([1e-6, ridge, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        w += np.clip(np.linalg.solve(hessian, x.T @ (y - p) - penalty @ w), -5, 5)
    return tuple(float(c) for c in w)


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of (doc_id, text) as (doc_id, held_out, score, predicted)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _linear(lexicon)
        for batch in batches:
            z = np.array([measure(text) for text in batch["text"].to_pylist()], float)
            scores = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], scores], ["doc_id", "held_out", "score"])

    rows = documents.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
    scored = rows.mapInArrow(predict, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _linear(lexicon: Lexicon):
    """The logit of a text's score."""
    automaton = lexicon.automaton()
    base, by_total, by_rate = lexicon.coefficients

    def measure(text: str | None) -> float:
        total, rate = features(fold(text or ""), automaton)
        return base + by_total * total + by_rate * rate

    return measure


def keep_clean(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents that are not toxic, with all their columns. The scan is scored in place, nothing is shuffled."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _linear(lexicon)
        for batch in batches:
            yield batch.filter(pa.array([measure(text.as_py()) < 0 for text in batch["text"]], pa.bool_()))

    return documents.mapInArrow(clean, documents.schema)
