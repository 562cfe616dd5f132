"""Raw events to vocabulary, and customer sequences to masked, padded training rows."""

from pyspark.sql import DataFrame, functions as F

from strandline.constants import CHUNK, SEED, WIDTH
from strandline.functions.text import clean_event, strip_underscores, vocabulary_text
from strandline.operators.encoding import (
    chunk_parts_from_end,
    copy_labels,
    encode,
    join_parts,
    pad_sequence,
    split_tail,
)
from strandline.operators.events import Route, default_time, route_events
from strandline.operators.masking import fill_rows, mask_multi, mask_tokens, mask_words
from strandline.operators.ordering import heavy_keys
from strandline.operators.sampling import split
from strandline.operators.sequences import (
    PART_SIZE,
    customer_sequences,
    month_sequences,
    to_text,
    unique_events,
    week_sequences,
)
from strandline.operators.vocabulary import train_wordpiece


def period_datasets(events: DataFrame, routes: dict[str, Route], **options) -> tuple[DataFrame, DataFrame]:
    """Weekly and monthly texts per customer."""
    routed = route_events(default_time(events), routes)
    options.setdefault("heavy", heavy_keys(routed, "column1", options.get("part_size", PART_SIZE)))
    return to_text(week_sequences(routed, **options)), to_text(month_sequences(routed, **options))


def vocabulary_events(events: DataFrame, routes: dict[str, Route]) -> DataFrame:
    """Every event text once, cleaned: the corpus of the vocabulary."""
    routed = route_events(default_time(events), routes).filter(F.col("evnt").isNotNull())
    unique = unique_events(routed.select(clean_event(F.col("evnt")).alias("evnt")))
    return unique.select(strip_underscores(F.col("evnt")).alias("evnt"))


def event_vocabulary(events: DataFrame, routes: dict[str, Route], **options) -> DataFrame:
    """Subword vocabulary of the event texts; each counts once, however often it happened."""
    return train_wordpiece(vocabulary_events(events, routes), **options)


def training_rows(
    routed: DataFrame,
    vocab: DataFrame,
    vocab_size: int,
    masking: str = "words",
    subword: bool = True,
    customer: str = "column1",
    seed: int = SEED,
    **options,
) -> DataFrame:
    """Rows (customer, chunk, split, input_ids, token_type_ids, attention_mask, labels).

    Whole customers go to one split. ``masking``: 'words', 'tokens', 'multi' or 'copy'. With ``subword``
    event texts are cleaned as those of ``event_vocabulary`` are.
    """
    if subword:
        routed = routed.withColumn("evnt", vocabulary_text(F.col("evnt")))
    texts = to_text(customer_sequences(routed, customer=customer, **options))
    starts = "starts" if masking == "words" else None
    ids = encode(texts, vocab, subword=subword, starts=starts)
    chunks = chunk_parts_from_end(ids, customer, size=CHUNK, starts=starts)
    rows = split(chunks, customer).withColumn("row_key", F.concat_ws("/", customer, "chunk"))
    if masking == "multi":
        masked = mask_multi(rows, "row_key", seed=seed)
    else:
        rows = pad_sequence(rows, starts=starts)
        if masking == "words":
            masked = mask_words(rows, "row_key", vocab_size, seed=seed, starts=starts)
        elif masking == "tokens":
            masked = mask_tokens(rows, "row_key", vocab_size, seed=seed)
        elif masking == "copy":
            masked = copy_labels(rows)
        else:
            raise ValueError("masking is 'words', 'tokens', 'multi' or 'copy'")
    return masked.select(customer, "chunk", "split", "input_ids", "token_type_ids", "attention_mask", "labels")


def fill_in_rows(
    texts: DataFrame,
    vocab: DataFrame,
    customer: str = "column1",
    text: str = "evnt",
    subword: bool = False,
    max_len: int = WIDTH,
) -> DataFrame:
    """Rows (customer, input_ids, token_type_ids, attention_mask, labels): the last events, to be filled in.

    ``texts`` has (customer, part, text). A word has an id at least, so ``max_len`` words of history are enough.
    """
    held = split_tail(texts.select(customer, "part", text), customer, text)
    rows = join_parts(held, customer, "history", max_len).withColumn("__goal", F.array_join("targets", " "))
    rows = encode(rows, vocab, "history", "__past_ids", subword=subword)
    rows = encode(rows, vocab, "__goal", "__goal_ids", subword=subword)
    filled = fill_rows(rows, "__past_ids", "__goal_ids", max_len)
    return filled.select(customer, "input_ids", "token_type_ids", "attention_mask", "labels")
