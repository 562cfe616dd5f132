"""Texts to id arrays, and id arrays to rows of fixed width."""

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.constants import (
    CHUNK,
    CLS,
    CONTINUATION,
    MAX_VOCABULARY,
    PAD,
    SEP,
    SPECIAL_PIECES,
    TAIL_WORDS,
    UNK,
    WIDTH,
)
from strandline.functions.text import last_items, spaced_texts, spaced_words, text_slices, words
from strandline.operators.ordering import split_heavy
from strandline.operators.trie import Trie
from strandline.operators.vocabulary import with_composed_text
from strandline.sources.shared import reliable_checkpoint, stored


def encode(
    df: DataFrame,
    vocab: DataFrame,
    text: str = "evnt",
    name: str = "input_ids",
    subword: bool = False,
    starts: str | None = None,
    max_pieces: int = MAX_VOCABULARY,
) -> DataFrame:
    """Add the ids of the text's words, or of the pieces they split into.

    Texts are taken in Unicode normal form C, as vocabularies are made. A vocabulary of up to ``max_pieces``, the cap
    of those made here, goes to every executor once, as a double-array trie of some 50 bytes a piece, so that no text is
    taken apart and shuffled. A larger one is not broadcast: distinct words meet it in joins, to the same result.
    ``starts`` names a second array to add: for each id whether a word starts there.
    """
    table = vocab.select("piece", "id").limit(max_pieces + 1).toArrow()
    if table.num_rows > max_pieces:
        return _encode_by_lookup(df, vocab, text, name, subword, starts)
    lookup = df.sparkSession.sparkContext.broadcast(Trie.of(table))
    found = df.withColumn("__found", _encoder(lookup, subword)(F.col(text).cast("string")))
    columns = {name: F.col("__found.ids")} | ({starts: F.col("__found.starts")} if starts else {})
    return found.withColumns(columns).drop("__found")


#: Text that is encoded at once; arrays over its words take some thirty times as much. A longer text comes alone.
SLICE_BYTES = 2 << 20


def encode_batch(trie: Trie, texts: pa.Array, subword: bool) -> pa.StructArray:
    """Ids and starts of a batch in Unicode normal form C, a few texts after the other."""
    parts = [trie.encode(_composed(some), subword) for some in text_slices(texts, SLICE_BYTES)]
    return pa.StructArray.from_arrays([pa.concat_arrays(column) for column in zip(*parts)], ["ids", "starts"])


def _composed(texts: pa.Array) -> pa.Array:
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        return texts
    return pa.array([t and unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def _encoder(lookup, subword: bool):
    @F.arrow_udf("struct<ids:array<int>,starts:array<boolean>>")
    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = lookup.value
        for texts in batches:
            yield encode_batch(trie, spaced_texts(texts), subword)

    return encode_texts.asNondeterministic()  # or a filter on its result would run it a second time


def _encode_by_lookup(df: DataFrame, vocab: DataFrame, text: str, name: str, subword: bool, starts: str | None) -> DataFrame:
    """``encode`` for a vocabulary of any size: distinct words are split by joins, and texts put together again."""
    rows = stored(df.withColumn("__row", F.monotonically_increasing_id()), "texts")
    texts = with_composed_text(rows.select("__row", F.col(text).alias("__text")), "__text")
    spread = texts.select("__row", F.posexplode(spaced_words(F.col("__text"))).alias("__i", "__word"))
    distinct = spread.select("__word").distinct()
    numbers = vocab.groupBy(F.col("piece").alias("__piece")).agg(F.max("id").alias("__id"))
    if subword:
        split = _split_by_join(distinct, numbers)
    else:
        found = distinct.join(numbers, F.col("__word") == F.col("__piece"), "left")
        split = found.select("__word", F.array(F.coalesce("__id", F.lit(UNK))).alias("__ids"))
    item = F.struct("__i", "__ids")
    gathered = spread.join(split, "__word").groupBy("__row").agg(F.sort_array(F.collect_list(item)).alias("__items"))
    result = rows.join(gathered, "__row", "left")
    each = F.coalesce(F.col("__items.__ids"), F.array().cast("array<array<int>>"))
    columns = {name: F.flatten(each)}
    if starts:
        columns[starts] = F.flatten(F.transform(each, lambda ids: F.transform(ids, lambda _, i: i == 0)))
    return result.withColumns(columns).select(*df.columns, *columns)


def _split_by_join(words_: DataFrame, numbers: DataFrame) -> DataFrame:
    """(__word, __ids): every stretch that may be a piece meets the vocabulary, then the longest ones are strung up."""
    longest = numbers.agg(F.max(F.length("__piece"))).first()[0] or 1
    places = words_.select("__word", F.explode(F.sequence(F.lit(1), F.length("__word"))).alias("__p"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("__word") - F.col("__p") + 1))
    stretches = places.select("__word", "__p", F.explode(lengths).alias("__k"))
    mark = F.when(F.col("__p") > 1, CONTINUATION).otherwise("")
    stretches = stretches.withColumn("__piece", F.concat(mark, F.expr("substr(__word, __p, __k)")))
    best = stretches.join(numbers, "__piece").groupBy("__word", "__p").agg(F.max(F.struct("__k", "__id")).alias("__best"))
    entries = F.map_from_entries(F.collect_list(F.struct("__p", "__best")))
    known = words_.join(best.groupBy("__word").agg(entries.alias("__at")), "__word", "left")

    def step(state: Column, place: Column) -> Column:
        piece = F.col("__at")[place]
        moved = F.struct((place + piece["__k"]).alias("next"), F.concat(state["ids"], F.array(piece["__id"])).alias("ids"))
        return F.when((state["next"] == place) & piece.isNotNull(), moved).otherwise(state)

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("ids"))
    end = F.aggregate(F.sequence(F.lit(1), F.length("__word")), start, step)
    whole = known.withColumn("__end", end)
    ids = F.when(F.col("__end.next") > F.length("__word"), F.col("__end.ids")).otherwise(F.array(F.lit(UNK)))
    return whole.select("__word", ids.alias("__ids"))


def encode_by_join(df: DataFrame, vocab: DataFrame, key: str, text: str = "evnt", name: str = "input_ids") -> DataFrame:
    """Rows (key, ids) of a word vocabulary of any size; ``key`` is unique per text.

    Unknown words get the id of [UNK]. The words meet the vocabulary in one equi-join,
    which adaptive execution broadcasts or splits by skew.
    """
    rows = with_composed_text(df.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__text")
    spread = rows.select("__key", F.posexplode_outer(spaced_words(F.col("__text"))).alias("__i", "__word"))
    ids = vocab.select(F.col("piece").alias("__word"), F.col("id").alias("__id"))
    item = F.when(F.col("__i").isNotNull(), F.struct("__i", F.coalesce("__id", F.lit(UNK)).alias("__id")))
    gathered = spread.join(ids, "__word", "left").groupBy("__key").agg(F.sort_array(F.collect_list(item)).alias("__items"))
    return gathered.select(F.col("__key").alias(key), F.col("__items.__id").alias(name))


def decode(df: DataFrame, vocab: DataFrame, ids: str = "input_ids", name: str = "pieces") -> DataFrame:
    """Ids back to pieces; ids that the vocabulary has not got become [UNK]."""
    rows = vocab.select("piece", "id").toArrow().sort_by("id")
    lookup = df.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), rows["piece"].combine_chunks()))
    unknown = SPECIAL_PIECES[UNK]

    @F.arrow_udf("array<string>")
    def decode_ids(arrays: pa.Array) -> pa.Array:
        numbers, pieces = lookup.value
        flat = arrays.flatten().fill_null(-1).to_numpy()
        if len(numbers):
            at = np.minimum(np.searchsorted(numbers, flat), len(numbers) - 1)
            found = pc.if_else(pa.array(numbers[at] == flat), pieces.take(pa.array(at)), unknown)
        else:
            found = pa.array([unknown] * len(flat), pa.string())
        sizes = pc.list_value_length(arrays)
        offsets = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy())]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), found, mask=sizes.is_null() if sizes.null_count else None)

    return df.withColumn(name, decode_ids.asNondeterministic()(ids))


def _ints(value: int, times: Column) -> Column:
    return F.array_repeat(F.lit(value), times.cast("int"))


def pad_sequence(
    df: DataFrame, ids: str = "input_ids", max_len: int = WIDTH, keep: str = "tail", starts: str | None = None
) -> DataFrame:
    """[CLS] ids [SEP] [PAD]..., attention mask and token types, all ``max_len`` wide.

    ``keep`` says which end of a longer sequence stays. ``starts``, flags beside the ids, are cut and filled alike:
    every special piece is a word.
    """
    if keep not in ("head", "tail"):
        raise ValueError("keep is 'head' or 'tail'")
    room = max_len - 2

    def kept(column: str) -> Column:
        return last_items(F.col(column), room) if keep == "tail" else F.slice(column, 1, room)

    used = F.size("__body") + 2
    if starts:
        yes = lambda n: F.array_repeat(F.lit(True), n)
        pads = (F.lit(max_len - 1) - F.least(F.size(starts), F.lit(room))).cast("int")
        df = df.withColumn(starts, F.concat(yes(F.lit(1)), kept(starts), yes(pads)))
    return (
        df.withColumn("__body", kept(ids))
        .withColumns(
            {
                "input_ids": F.concat(F.array(F.lit(CLS)), "__body", F.array(F.lit(SEP)), _ints(PAD, max_len - used)),
                "token_type_ids": F.array_repeat(F.lit(0), max_len),
                "attention_mask": F.concat(_ints(1, used), _ints(0, max_len - used)),
            }
        )
        .drop("__body")
    )


def chunk_from_end(df: DataFrame, ids: str = "input_ids", size: int = CHUNK, starts: str | None = None) -> DataFrame:
    """Rows of at most ``size`` ids, ``chunk`` 0 the newest: only the oldest can be short.

    ``starts``, flags beside the ids, are cut with them.
    """
    n = F.size(ids)
    count = F.ceil(n / F.lit(size)).cast("int")
    cut = [ids, starts] if starts else [ids]

    def piece(i: Column) -> Column:
        high = n - i * size
        low = F.greatest(F.lit(0), high - size)
        pieces = [F.slice(column, low + 1, high - low).alias(column) for column in cut]
        return F.struct(*pieces) if starts else pieces[0]

    others = [c for c in df.columns if c not in cut]
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), piece))  # null gives no rows
    if not starts:
        return df.select(*others, F.posexplode(chunks).alias("chunk", ids))
    return df.select(*others, F.posexplode(chunks).alias("chunk", "__cut")).select(*others, "chunk", "__cut.*")


def chunk_parts_from_end(
    df: DataFrame, key: str, part: str = "part", ids: str = "input_ids", size: int = CHUNK, starts: str | None = None
) -> DataFrame:
    """The same chunks for sequences stored in several parts, as if each were one row.

    Sequences in one part, as nearly all are, take no shuffle. For the others the lengths
    of the parts are added up per key; every part then cuts itself on the common grid, and
    the few pieces of a chunk, ``size`` ids at most, are joined up.
    """
    cut = [ids, starts] if starts else [ids]
    single, rest = _parts_apart(df.select(key, part, *cut), key, part)
    chunks = chunk_from_end(single.drop(part), ids, size, starts)
    return chunks if rest is None else chunks.unionByName(_chunk_parts(rest, key, part, cut, size))


def _chunk_parts(df: DataFrame, key: str, part: str, columns: list[str], size: int) -> DataFrame:
    ids = columns[0]
    lengths = df.select(F.col(key).alias("__key"), F.col(part).alias("__part"), F.size(ids).alias("__n"))
    later = Window.partitionBy("__key").orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.withColumn("__after", F.coalesce(F.sum("__n").over(later), F.lit(0))).filter("__n > 0")
    rows = df.join(lengths, F.col(key).eqNullSafe(F.col("__key")) & (F.col(part) == F.col("__part")))
    cut = rows.withColumn(
        "chunk",
        F.explode(F.sequence(F.floor(F.col("__after") / size), F.floor((F.col("__after") + F.col("__n") - 1) / size))),
    )
    end = F.col("__after") + F.col("__n")  # distance of the part's first id from the end of the sequence
    high = F.least(F.col("__n").cast("long"), end - F.col("chunk") * size)
    low = F.greatest(F.lit(0).cast("long"), end - (F.col("chunk") + 1) * size)
    pieces = [F.slice(c, (low + 1).cast("int"), (high - low).cast("int")).alias(f"__{i}") for i, c in enumerate(columns)]
    gathered = cut.groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct(F.col(part), *pieces))).alias("__pieces"))
    return gathered.select(
        key, F.col("chunk").cast("int"), *[F.flatten(f"__pieces.__{i}").alias(c) for i, c in enumerate(columns)]
    )


def copy_labels(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    return df.withColumn("labels", F.col(ids))


def _parts_apart(df: DataFrame, key: str, part: str) -> tuple[DataFrame, DataFrame | None]:
    """Sequences in one part, as nearly all are, and the others if there are any."""
    several = reliable_checkpoint(df.filter(F.col(part) > 0).select(F.col(key).alias("__heavy")).distinct())
    return split_heavy(df, key, several)


def _with_later_words(df: DataFrame, key: str, part: str) -> DataFrame:
    """Adds ``__after``, the words in later parts, and ``__all``, those of the whole sequence, to rows with ``__words``.

    Only lengths meet in the window: one narrow row per part.
    """
    lengths = df.select(F.col(key).alias("__key"), F.col(part).alias("__part"), F.size("__words").alias("__n"))
    later = Window.partitionBy("__key").orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select(
        "__key",
        "__part",
        F.coalesce(F.sum("__n").over(later), F.lit(0)).alias("__after"),
        F.sum("__n").over(Window.partitionBy("__key")).alias("__all"),
    )
    return df.join(lengths, F.col(key).eqNullSafe(F.col("__key")) & (F.col(part) == F.col("__part"))).drop("__key", "__part")


def split_tail(df: DataFrame, key: str, text: str = "evnt", n: int = TAIL_WORDS, part: str = "part") -> DataFrame:
    """Hold out the last n words of each sequence: text ``history`` and array ``targets``; needs more than n words.

    A sequence in several parts stays in several rows, each with its part of the history and the targets of the
    whole. Parts that are all targets have no row.
    """
    rows = df.withColumn("__words", words(F.col(text)))
    single, several = _parts_apart(rows, key, part)
    single = single.filter(F.size("__words") > n).withColumn("targets", last_items(F.col("__words"), n))
    result = _history(single, F.lit(n))
    if several is None:
        return result
    placed = _with_later_words(several, key, part).filter(F.col("__all") > n)
    mine = F.greatest(F.lit(0), F.least(F.size("__words").cast("long"), F.lit(n) - F.col("__after"))).cast("int")
    placed = placed.withColumn("__mine", mine)
    pieces = placed.filter("__mine > 0").select(
        F.col(key).alias("__key"), F.struct(F.col(part), last_items(F.col("__words"), F.col("__mine")).alias("__tail")).alias("__piece")
    )
    targets = pieces.groupBy("__key").agg(F.sort_array(F.collect_list("__piece")).alias("__pieces"))  # n words at most
    joined = placed.join(targets, F.col(key).eqNullSafe(F.col("__key")))
    long = joined.withColumn("targets", F.flatten("__pieces.__tail"))
    long = _history(long.filter(F.size("__words") > F.col("__mine")), F.col("__mine"))
    return result.unionByName(long.select(result.columns))


def _history(df: DataFrame, n: Column) -> DataFrame:
    history = F.array_join(F.slice("__words", F.lit(1), F.size("__words") - n), " ")
    return df.withColumn("history", history).drop("__words")


def join_parts(df: DataFrame, key: str, text: str, n: int, part: str = "part") -> DataFrame:
    """One row per sequence with the last n words of its text; the other columns are those of its last part."""
    rows = df.withColumn("__words", words(F.col(text)))
    single, several = _parts_apart(rows, key, part)
    result = single.withColumn(text, F.array_join(last_items(F.col("__words"), n), " ")).drop("__words", part)
    if several is None:
        return result
    placed = _with_later_words(several, key, part).filter(F.col("__after") < n)
    tail = last_items(F.col("__words"), (F.lit(n) - F.col("__after")).cast("int"))
    others = [c for c in result.columns if c not in (key, text)]
    row = F.struct(F.col(part).alias("__part"), tail.alias("__tail"), *others)
    gathered = placed.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("__rows"))  # n words at most
    last = F.element_at("__rows", -1)
    long = gathered.select(
        key, F.array_join(F.flatten("__rows.__tail"), " ").alias(text), *[last[c].alias(c) for c in others]
    )
    return result.unionByName(long.select(result.columns))
