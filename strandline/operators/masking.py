"""Masked training rows. Every draw is a hash of seed, row key and position."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from strandline.constants import (
    CLS,
    CONTINUATION,
    IGNORE,
    MASK,
    MASK_PROBABILITY,
    MIN_MASKED_TOKENS,
    PAD,
    SEED,
    SEP,
    SPECIAL_PIECES,
    TOKEN_MASK_PROBABILITY,
    WIDTH,
)
from strandline.functions.hashing import draw, hash_hex, hex_bar, hit, hits
from strandline.functions.text import last_items
from strandline.operators.encoding import pad_sequence


def mask_multi(
    df: DataFrame,
    key: str,
    ids: str = "input_ids",
    p: float = MASK_PROBABILITY,
    min_tokens: int = MIN_MASKED_TOKENS,
    max_len: int = WIDTH,
    seed: int = SEED,
    rounds: int = 3,
) -> DataFrame:
    """At least two masks in every sequence of more than ``min_tokens`` - 2 ids.

    A draw with fewer masks is repeated with the next round's hash; after the last round
    the two ids with the smallest hashes of the first one are masked.
    """
    room = max_len - 2

    def draws(round_: int) -> Column:
        return F.transform("__ids", lambda _, i: hash_hex(seed, F.col(key), round_, i))

    # Smallest two of the first round; the sort inside the lambda runs for hardly any row.
    picked = F.transform("__first", lambda h: h <= F.get(F.sort_array("__first"), 1))
    for round_ in reversed(range(rounds)):
        hits = F.transform(F.col("__first") if round_ == 0 else draws(round_), lambda h: h < hex_bar(p))
        picked = F.when(F.size(F.filter(hits, lambda hit: hit)) >= 2, hits).otherwise(picked)

    rows = (
        df.withColumn("__ids", F.slice(ids, 1, room))
        .filter(F.size(ids) > min_tokens - 2)
        .withColumn("__first", draws(0))
        .withColumn("__hits", picked)
        .withColumn("__labels", F.zip_with("__ids", "__hits", lambda t, hit: F.when(hit, t).otherwise(F.lit(IGNORE))))
        .withColumn(ids, F.zip_with("__ids", "__hits", lambda t, hit: F.when(hit, F.lit(MASK)).otherwise(t)))
    )
    return _with_labels(pad_sequence(rows, ids, max_len), max_len).drop("__ids", "__first", "__hits")


def _with_labels(df: DataFrame, max_len: int) -> DataFrame:
    """Labels one to the right, as [CLS] stands in front, and ignored elsewhere."""
    rest = (F.lit(max_len - 1) - F.size("__labels")).cast("int")
    labels = F.concat(F.array(F.lit(IGNORE)), "__labels", F.array_repeat(F.lit(IGNORE), rest))
    return df.withColumn("labels", labels).drop("__labels")


def _replace_chosen(df: DataFrame, hits: Column, key: str, ids: str, vocab_size: int, seed: int) -> DataFrame:
    """Of the hit ids 80% become [MASK], 10% a random id, 10% stay; labels hold them all.

    ``hits`` is an array of conditions beside the ids; special ids are never taken. It goes
    into the lambda zipped to the ids: read from outside, it would be made again per id.
    """

    def at(x: Column, i: Column) -> Column:
        t = x["id"]
        branch = hash_hex(seed, "branch", F.col(key), i)
        random_id = F.floor(draw(seed, "id", F.col(key), i) * vocab_size).cast("int")
        new = F.when(branch < hex_bar(0.8), F.lit(MASK)).when(branch < hex_bar(0.9), random_id).otherwise(t)
        return F.when((t >= len(SPECIAL_PIECES)) & x["hit"], F.struct(new.alias("id"), t.alias("label"))).otherwise(
            F.struct(t.alias("id"), F.lit(IGNORE).alias("label"))
        )

    zipped = F.zip_with(ids, hits, lambda t, hit: F.struct(t.alias("id"), hit.alias("hit")))
    return (
        df.withColumn("__pairs", F.transform(zipped, at))
        .withColumn(ids, F.col("__pairs.id"))
        .withColumn("labels", F.col("__pairs.label"))
        .drop("__pairs")
    )


def mask_tokens(
    df: DataFrame, key: str, vocab_size: int, ids: str = "input_ids", p: float = TOKEN_MASK_PROBABILITY, seed: int = SEED
) -> DataFrame:
    """Choose every id by itself."""
    chosen = F.transform(ids, lambda _, i: hit(p, seed, "token", F.col(key), i))
    return _replace_chosen(df, chosen, key, ids, vocab_size, seed)


def mask_words(
    df: DataFrame,
    key: str,
    vocab_size: int,
    ids: str = "input_ids",
    pieces: str = "pieces",
    p: float = MASK_PROBABILITY,
    seed: int = SEED,
    starts: str | None = None,
) -> DataFrame:
    """Choose whole words: a first piece together with its continuation pieces. A row may begin
    inside a word; that rest counts as word 0, so the first full word is word 1.

    What belongs together is told by ``starts``, the flags that ``encode`` gives, or else by the marks of ``pieces``.
    """
    if starts:
        chosen = _word_hits(F.col(starts), lambda number: hit(p, seed, "word", F.col(key), number))
        return _replace_chosen(df, chosen, key, ids, vocab_size, seed)
    glue = "\x01"
    whole = F.split(F.replace(F.array_join(pieces, " "), F.lit(f" {CONTINUATION}"), F.lit(glue)), " ")
    first = F.when(F.get(pieces, 0).startswith(CONTINUATION), 0).otherwise(1)

    rows = df.withColumn("__words", whole)
    rows = rows.withColumn("__drawn", hits(p, F.size("__words") + first, seed, "word", F.col(key)))
    drawn = F.slice("__drawn", first + 1, F.size("__words"))
    chosen = F.flatten(F.zip_with("__words", drawn, lambda word, one: F.array_repeat(one, F.size(F.split(word, glue)))))
    return _replace_chosen(rows, chosen, key, ids, vocab_size, seed).drop("__words", "__drawn")


def _word_hits(starts: Column, hit_of: Callable[[Column], Column]) -> Column:
    """For each id the draw of its word, one draw a word: the runs between starts are as long as the words."""
    places = F.filter(F.transform(starts, lambda flag, i: F.when(flag, i)), lambda i: i.isNotNull())
    inside = ~F.coalesce(F.get(starts, F.lit(0)), F.lit(True))
    begins = F.when(inside, F.concat(F.array(F.lit(0)), places)).otherwise(places)
    ends = F.concat(places, F.array(F.size(starts)))
    ends = F.when(inside, ends).otherwise(F.slice(ends, F.lit(2), F.greatest(F.size(ends) - 1, F.lit(0))))
    runs = F.zip_with(begins, ends, lambda a, b: b - a)
    first = F.when(inside, 0).otherwise(1)
    return F.flatten(F.transform(runs, lambda run, i: F.array_repeat(hit_of(first + i), run)))


def fill_rows(df: DataFrame, history: str = "history_ids", targets: str = "target_ids", max_len: int = WIDTH) -> DataFrame:
    """History, one [MASK] per target piece, [SEP]; labels: the target ids and the [SEP].

    A history that is too long loses its oldest ids, so masks and labels stay in line. Targets
    wider than the whole row fail.
    """
    m = F.size(targets)
    too_wide = F.raise_error(F.lit(f"targets don't fit into rows of {max_len} ids")).cast("array<int>")
    rows = df.withColumn("__goal", F.when(m > max_len - 2, too_wide).otherwise(F.col(targets))).withColumn("__past", last_items(F.col(history), F.lit(max_len - 2) - m))
    used = F.size("__past") + F.size("__goal") + 2
    pads = (F.lit(max_len) - used).cast("int")
    masks = F.transform("__goal", lambda _: F.lit(MASK))
    quiet = F.transform("__past", lambda _: F.lit(IGNORE))
    return rows.withColumns(
        {
            "input_ids": F.concat(
                F.array(F.lit(CLS)), "__past", masks, F.array(F.lit(SEP)), F.array_repeat(F.lit(PAD), pads)
            ),
            "token_type_ids": F.array_repeat(F.lit(0), max_len),
            "attention_mask": F.concat(F.array_repeat(F.lit(1), used.cast("int")), F.array_repeat(F.lit(0), pads)),
            "labels": F.concat(
                F.array(F.lit(IGNORE)), quiet, "__goal", F.array(F.lit(SEP)), F.array_repeat(F.lit(IGNORE), pads)
            ),
        }
    ).drop("__goal", "__past")
