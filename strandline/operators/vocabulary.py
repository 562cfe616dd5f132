"""Word and subword vocabularies as tables (piece, id, freq)."""

import base64
import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.constants import CONTINUATION, MAX_VOCABULARY, MIN_FREQUENCY, SPECIAL_PIECES
from strandline.functions.text import spaced_texts, text_slices
from strandline.operators.merge_rounds import LinkedWords, merge_rounds, risen_bar
from strandline.operators.merging import NumberedWords, PieceNumbers, finish, first_pieces, joined
from strandline.operators.ordering import with_position
from strandline.sources.shared import stored

#: Pieces that one task merges one pair at a time, some 200 MB of them.
SMALL_PIECES = 1_000_000
#: Pieces of a shard at first: 2 MB, and some twenty times that while a round goes over it.
SHARD_PIECES = 500_000
#: Pairs that a round looks at, the best ones; every task gets them.
ROUND_PAIRS = 20_000
#: Pieces that a task holds in memory for all rounds, some 25 bytes each, and how many of them are a shard.
ROUND_PIECES, LINKED_PIECES = 20_000_000, 4_000_000
#: Tasks at most that agree on the merges of a round; what one tells, all of them read.
ROUND_TASKS = 32
#: Rounds after which the changes of counts are added up.
COMPACT_ROUNDS = 8
#: Text whose words are counted at once; a longer text comes alone.
COUNTED_BYTES = 8 << 20


def word_counts(df: DataFrame, text: str = "evnt", min_frequency: int = 1, limit: int | None = None) -> DataFrame:
    """Rows (word, freq) in Unicode normal form C; ``limit`` keeps the most frequent words, ties by word.

    Words are counted in stretches of texts first, so that a row is made for a word of a stretch and not for each one.
    """
    some = df.select(F.col(text).cast("string").alias("text")).mapInArrow(_count_words, "word string, freq bigint")
    some = some.select(composed(F.col("word")).alias("word"), "freq")
    counts = some.groupBy("word").agg(F.sum("freq").alias("freq")).filter(F.col("freq") >= min_frequency)
    if limit is None:
        return counts
    ranked = with_position(counts, F.col("freq").desc(), F.col("word"))
    return ranked.filter(F.col("position") < limit).drop("position")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_slices(batch["text"], COUNTED_BYTES):
            counted = pc.split_pattern(spaced_texts(texts), " ").flatten().value_counts()
            found = pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts").cast(pa.int64())], ["word", "freq"])
            yield found.filter(pc.not_equal(found["word"], ""))  # of empty texts


def word_vocabulary(
    df: DataFrame,
    text: str = "evnt",
    min_frequency: int = MIN_FREQUENCY,
    max_size: int = MAX_VOCABULARY,
    specials: tuple[str, ...] = SPECIAL_PIECES,
) -> DataFrame:
    """Special pieces first, then the words by frequency."""
    counts = word_counts(df, text, min_frequency).withColumnRenamed("word", "piece")
    return _numbered(counts, specials).filter(F.col("id") < max_size)


def _numbered(pieces: DataFrame, specials: tuple[str, ...]) -> DataFrame:
    ordinary = pieces.filter(~F.col("piece").isin(*specials))
    ranked = with_position(ordinary, F.col("freq").desc(), F.col("piece"))
    numbered = ranked.select("piece", (F.col("position") + len(specials)).cast("int").alias("id"), "freq")
    first = [(piece, i, None) for i, piece in enumerate(specials)]
    return pieces.sparkSession.createDataFrame(first, "piece string, id int, freq long").unionByName(numbered)


def train_wordpiece(
    df: DataFrame,
    text: str = "evnt",
    vocab_size: int = MAX_VOCABULARY,
    min_frequency: int = MIN_FREQUENCY,
    limit_alphabet: int = MAX_VOCABULARY,
    specials: tuple[str, ...] = SPECIAL_PIECES,
    small: int = SMALL_PIECES,
) -> DataFrame:
    """Subword vocabulary: single characters, then merges of frequent neighbours.

    Words are counted, and from then on only distinct words matter. They lie in shards, as arrays of numbers of pieces,
    which stay in the memory of tasks that run at the same time and agree on every round; with ``ROUND_PIECES`` pieces left,
    of one task (``merge_rounds``). Where tasks can't wait for each other, or there are too many words for their memory,
    shards are stored, and a round is jobs over them.

    The textbook way merges the one most frequent pair per round. Here a round merges every
    pair that beats all pairs it overlaps with, wherever it occurs: nothing that the
    textbook way merges earlier can touch it, so it will be merged there with the same
    count. Thousands of merges then take some dozens of rounds. (A piece that arises from two different pairs can
    still shift a close race.) Once the cap is reached, only pairs more frequent than the last piece inside matter.
    When the words that are not whole have at most ``small`` pieces, a bound whatever the input, the rest is done one
    merge at a time in one task.

    ``freq`` is how often the piece occurred when it came in. The pairs merged pass through
    the driver, at most ``vocab_size`` of them in a round.
    """
    counts = stored(word_counts(df, text), "words")
    words = _limit_alphabet(counts, limit_alphabet)
    words = counts if words is counts else stored(words.select("word", "freq"), "words")
    single = words.select("freq", _initial_pieces().alias("pieces"))
    alphabet = (
        single.select(F.explode("pieces").alias("piece"), "freq")
        .select(F.inline(F.array(_weighted(F.col("piece"), F.col("freq")), _weighted(_bare(F.col("piece")), F.lit(0)))))
        .groupBy("piece")
        .agg(F.sum("freq").alias("freq"))
    )
    room = max(0, vocab_size - len(specials) - alphabet.count())
    made = _merges(words.filter(F.length("word") > 1), room, min_frequency, small) if room else {}
    kept = sorted(made.items(), key=lambda item: (-item[1], item[0]))[:room]
    pieces = alphabet.unionByName(df.sparkSession.createDataFrame(kept, "piece string, freq long"))
    return _numbered(pieces.groupBy("piece").agg(F.max("freq").alias("freq")), specials)


def _merges(words: DataFrame, room: int, min_frequency: int, small: int) -> dict[str, int]:
    """The pieces that merges make, with their counts; a few more than ``room`` perhaps."""
    made: dict[str, int] = {}
    numbers = PieceNumbers()
    none = F.lit(None)
    pieces = words.agg(F.sum(F.length("word"))).first()[0] or 0
    rest = words.select(none.cast("binary").alias("pieces"), none.cast("binary").alias("freqs"), "word", "freq")
    if pieces > small:
        tasks = _tasks_at_once(words.sparkSession)
        if pieces <= ROUND_PIECES or 1 < tasks and pieces <= tasks * ROUND_PIECES:
            shards = _rounds_in_memory(rest, pieces, tasks, made, room, min_frequency, small)
        else:
            shards = _rounds_by_jobs(words, pieces, made, numbers, room, min_frequency, small)
        if shards is None:
            return made
        for piece in made:
            numbers.number(piece)
        rest = shards.select("*", none.cast("string").alias("word"), none.cast("long").alias("freq"))
    bar = risen_bar(made, room, min_frequency)
    last = rest.repartition(1).mapInArrow(_finish(numbers, made, room, bar), "piece string, n bigint")  # ``small`` pieces at most
    return dict(map(tuple, last.collect())) | made


def _tasks_at_once(spark: SparkSession) -> int:
    """How many tasks can wait for each other."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    return min(ROUND_TASKS, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def _rounds_in_memory(
    rest: DataFrame, pieces: int, tasks: int, made: dict[str, int], room: int, bar: int, small: int
) -> DataFrame | None:
    """Fill in what rounds make; the words that are left, None if no merges are.

    More pieces than one task holds are first in several, which wait for each other twice in a round, a second or so each time.
    """
    for together in [tasks, 1] if pieces > ROUND_PIECES else [1]:
        stop = max(small, ROUND_PIECES) if together > 1 else small
        run = _run_rounds(made, room, bar, min(room, ROUND_PAIRS), stop, together > 1)
        state = stored(rest.repartition(together).mapInArrow(run, _ROUNDS, barrier=together > 1), "subwords")
        told = sorted(map(tuple, state.filter("place is not null").select("place", "piece", "n").collect()))
        made |= {piece: n for _, piece, n in told if piece is not None}
        if not told or told[-1][2]:
            return None
        shards = state.filter("pieces is not null").select("pieces", "freqs")
        rest = shards.select("*", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("freq"))
        if stop == small:
            break
    return shards


#: A row with a shard of what is left, or what was made, by place; the last one has no piece and says whether that is all.
_ROUNDS = "pieces binary, freqs binary, place int, piece string, n bigint"
_ROUND_TYPES = {"pieces": pa.binary(), "freqs": pa.binary(), "place": pa.int32(), "piece": pa.string(), "n": pa.int64()}


def _run_rounds(made: dict[str, int], room: int, bar: int, limit: int, small: int, together: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = list(_linked(batches))
        pieces = dict(made)
        gather = _gather if together else lambda value: [value]
        ended = merge_rounds(shards, gather, pieces, room, bar, limit, small)
        if not ended:
            for shard in shards:
                parts = (pa.array([part.tobytes()], pa.binary()) for part in shard.rest())
                yield _rows(**dict(zip(("pieces", "freqs"), parts)))
        if not TaskContext.get().partitionId():
            columns = {"place": range(len(pieces) + 1), "piece": [*pieces, None], "n": [*pieces.values(), int(ended)]}
            yield _rows(**{name: pa.array(values, _ROUND_TYPES[name]) for name, values in columns.items()})

    return run


def _gather(value) -> list:
    """The value of every task that runs at the same time, in the order of tasks."""
    told = BarrierTaskContext.get().allGather(base64.b64encode(pickle.dumps(value)).decode())
    return [pickle.loads(base64.b64decode(each)) for each in told]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[LinkedWords]:
    """Shards of words, or of what is left of them; one at least."""
    some: list[NumberedWords] = [NumberedWords.of([], [])]
    for batch in batches:
        whole = batch.filter(pc.is_valid(batch["word"]))
        some.append(NumberedWords.of(whole["word"].to_pylist(), whole["freq"].to_pylist()))
        some += _read_shards(batch.filter(pc.is_valid(batch["pieces"])))
        if sum(len(words.pieces) for words in some) >= LINKED_PIECES:
            yield _one_shard(some)
            some = some[:1]
    yield _one_shard(some)


def _one_shard(some: list[NumberedWords]) -> LinkedWords:
    return LinkedWords(*(np.concatenate([getattr(words, part) for words in some]) for part in ("pieces", "freqs")))


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    """A batch with the columns that are given, the others null."""
    n = len(next(iter(columns.values())))
    arrays = [columns.get(name, pa.nulls(n, kind)) for name, kind in _ROUND_TYPES.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_ROUND_TYPES))


def _rounds_by_jobs(
    words: DataFrame, pieces: int, made: dict[str, int], numbers: PieceNumbers, room: int, min_frequency: int, small: int
) -> DataFrame | None:
    """The same with a few jobs a round, which need no more memory with more words."""
    bar = min_frequency
    partitions = max(words.sparkSession.sparkContext.defaultParallelism, -(-pieces // SHARD_PIECES))
    shard = F.pmod(F.xxhash64("word"), F.lit(partitions)).cast("int").alias("shard")
    state = stored(words.select(shard, "word", "freq").groupBy("shard").applyInArrow(_build_shard, _STATE), "subwords")
    counts, rounds = state.filter("pair is not null").select("pair", "n"), 0
    while best := _best(counts, numbers, bar, min(room, ROUND_PAIRS)):
        shards = state.filter("pieces is not null").select("pieces", "freqs")
        seen = [tuple(row) for row in shards.mapInArrow(_look(np.array([key for key, _ in best])), "place int, left bigint").collect()]
        if sum(left for _, left in seen if left is not None) <= small:
            return shards
        beaten = {place for place, left in seen if left is None}
        merges = {}
        for key, n in (pair for place, pair in enumerate(best) if place not in beaten):
            piece = joined(numbers.text(key >> 32), numbers.text(key & 0xFFFFFFFF))
            made.setdefault(piece, n)
            merges[key] = numbers.number(piece)
        bar = risen_bar(made, room, min_frequency)
        state = stored(shards.mapInArrow(_merge_shards(merges), _STATE), "subwords")
        counts, rounds = counts.unionByName(state.filter("pair is not null").select("pair", "n")), rounds + 1
        if rounds % COMPACT_ROUNDS == 0:
            counts = stored(counts.groupBy("pair").agg(F.sum("n").alias("n")).filter("n != 0"), "pairs")
    return None


#: A row with the words of a shard, and rows with what the counts of its pairs have changed by.
_STATE = "pieces binary, freqs binary, pair bigint, n bigint"


def _state_table(words: NumberedWords, changes: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    state = pa.table({"pieces": pa.array([words.pieces.tobytes()], pa.binary()), "freqs": pa.array([words.freqs.tobytes()], pa.binary())})
    return pa.concat_tables([state, pa.table(dict(zip(("pair", "n"), changes)))], promote_options="default")


def _read_shards(batch: pa.RecordBatch) -> Iterator[NumberedWords]:
    for pieces, freqs in zip(batch["pieces"], batch["freqs"]):
        yield NumberedWords(np.frombuffer(pieces.as_buffer(), np.int32), np.frombuffer(freqs.as_buffer(), np.int64))


def _build_shard(table: pa.Table) -> pa.Table:
    words = NumberedWords.of(table["word"].to_pylist(), table["freq"].to_pylist())
    return _state_table(words, words.counts())


def _look(ranked: np.ndarray):
    """Rows (place, null) of pairs that overlap with a better one, and for each shard (null, pieces left)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _read_shards(batch):
                places = [*words.beaten(ranked).tolist(), None]
                left = [*[None] * (len(places) - 1), words.pieces_left()]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(left, pa.int64())], ["place", "left"])

    return look


def _merge_shards(merges: dict[int, int]):
    pairs = np.array(sorted(merges), np.int64)
    new = np.array([merges[pair] for pair in pairs.tolist()], np.int32)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _read_shards(batch):
                changes = words.merge(pairs, new)
                yield from _state_table(words, changes).to_batches()

    return merge


def _finish(numbers: PieceNumbers, made: dict[str, int], room: int, bar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, freqs = [], []
        for batch in batches:
            for word, freq in zip(batch["word"].to_pylist(), batch["freq"].to_pylist()):
                if word is not None:
                    words.append(first_pieces(word))
                    freqs.append(freq)
            for shard in _read_shards(batch.filter(pc.is_valid(batch["pieces"]))):
                words += [list(map(numbers.text, word)) for word in shard.words()]
                freqs += shard.freqs.tolist()
        found = finish(words, freqs, made, room, bar)
        columns = [pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "n"])

    return run


def _weighted(piece: Column, freq: Column) -> Column:
    return F.struct(piece.alias("piece"), freq.cast("long").alias("freq"))


#: Characters that may not be in normal form C: all but Latin, Greek, Cyrillic and Kana letters and marks that have no
#: other form, Han and Hangul, whatever stands beside them.
PERHAPS_DECOMPOSED = (
    r"[^\u0000-\u02FF\u0370-\u0373\u0375-\u037D\u0388-\u0482\u048A-\u052F\u2010-\u2027\u3041-\u3096\u30A1-\u30FA"
    r"\u4E00-\u9FFF\uAC00-\uD7A3]"
)


def with_composed_text(df: DataFrame, text: str) -> DataFrame:
    """The rows with their text in Unicode normal form C."""
    return df.withColumn(text, composed(F.col(text)))


def composed(text: Column) -> Column:
    """Unicode normal form C. Only texts that may be in another form are handed to Python."""
    return F.coalesce(_normal_form()(F.when(_perhaps_decomposed(text), text)), text)


def _perhaps_decomposed(text: Column) -> Column:
    """A match of the whole text is one loop, and some 20 times as fast as a search for a character of the others."""
    return ~text.rlike(PERHAPS_DECOMPOSED.replace("[^", r"\A[", 1) + r"*+\z")


def _normal_form():
    @F.arrow_udf("string")
    def nfc(texts: pa.Array) -> pa.Array:
        if texts.null_count == len(texts):
            return texts
        return pa.array([t and unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return nfc


def _chars(word) -> Column:
    return F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))


def _limit_alphabet(words: DataFrame, limit: int) -> DataFrame:
    """Leave out the rarest characters beyond the limit (at most all of Unicode remain)."""
    chars = words.select(F.explode(_chars("word")).alias("char"), "freq").groupBy("char").agg(F.sum("freq").alias("n"))
    if chars.count() <= limit:
        return words
    ranked = with_position(chars, F.col("n").desc(), F.col("char"))
    kept = ranked.filter(F.col("position") < limit).select("char")
    spread = words.select("word", "freq", F.posexplode(_chars("word")).alias("i", "char")).join(kept, "char")
    letters = F.sort_array(F.collect_list(F.struct("i", "char")))
    return spread.groupBy("word", "freq").agg(F.array_join(F.transform(letters, lambda x: x["char"]), "").alias("word2")).select(
        F.col("word2").alias("word"), "freq"
    )


def _initial_pieces() -> Column:
    return F.transform(_chars("word"), lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(CONTINUATION), c)))


def _bare(piece: Column) -> Column:
    return F.when(piece.startswith(CONTINUATION) & (F.length(piece) > 2), F.substring(piece, 3, 1)).otherwise(piece)


def _best(counts: DataFrame, numbers: PieceNumbers, bar: int, limit: int) -> list[tuple[int, int]]:
    """The ``limit`` best pairs of at least ``bar`` occurrences, (pair, n), ties by text.

    What beats one of them is one of them, so whether they overlap with a better pair can be told among them.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = batch["pair"].to_numpy()
            texts = [pa.array(list(map(numbers.text, half.tolist())), pa.string()) for half in (pairs >> 32, pairs & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays([batch["pair"], batch["n"], *texts], ["pair", "n", "left", "right"])

    pairs = counts.groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= bar)
    texts = pairs.mapInArrow(named, "pair bigint, n bigint, left string, right string")
    return [(row[0], row[1]) for row in texts.orderBy(F.desc("n"), "left", "right").limit(limit).collect()]
