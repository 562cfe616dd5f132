import math

import pytest
from pyspark.sql import functions as F

from strandline.functions.hashing import draw, hit
from strandline.functions.text import clean_event, last_words, strip_underscores
from strandline.operators.encoding import (
    chunk_from_end,
    chunk_parts_from_end,
    decode,
    encode,
    encode_by_join,
    pad_sequence,
    join_parts,
    split_tail,
)
from strandline.operators.masking import fill_rows, mask_multi, mask_tokens, mask_words
from strandline.operators.scoring import fill_next, next_event_model, score
from strandline.operators.vocabulary import word_vocabulary


def id_rows(spark, *lengths):
    return spark.createDataFrame([(n, [5 + i % 90 for i in range(n)]) for n in lengths], "id int, input_ids array<int>")


def test_cleaning(spark):
    df = spark.createDataFrame([("가게 A-1_b é!",)], "t string")
    assert df.select(clean_event("t"), strip_underscores("t"), last_words(F.col("t"), 2)).first()[:] == (
        "가게A_1_b__", "가게 A-1b é!", "A-1_b é!",
    )


def test_hit_is_the_same_as_a_small_draw(spark):
    df = spark.range(5000)
    for share in (0.0, 0.15, 0.5, 1.0):
        assert df.filter(hit(share, 1, F.col("id")) != (draw(1, F.col("id")) < share)).isEmpty()


@pytest.mark.parametrize("keep", ["head", "tail"])
def test_padding(spark, keep):
    for row in pad_sequence(id_rows(spark, 0, 1, 253, 254, 255, 300).withColumn("raw", F.col("input_ids")), keep=keep).collect():
        body = row.raw[:254] if keep == "head" else row.raw[-254:]
        used = len(body) + 2
        assert row.input_ids == [2, *body, 3] + [1] * (256 - used)
        assert row.attention_mask == [1] * used + [0] * (256 - used)
        assert row.token_type_ids == [0] * 256


def test_chunks_join_up_again(spark):
    lengths = [0, 1, 254, 255, 508, 700]
    found = {}
    for r in chunk_from_end(id_rows(spark, *lengths)).collect():
        found.setdefault(r.id, {})[r.chunk] = r.input_ids
    assert set(found) == set(lengths) - {0}
    for n, chunks in found.items():
        assert len(chunks) == math.ceil(n / 254)
        assert all(len(c) == 254 for i, c in chunks.items() if i < max(chunks))
        assert sum((chunks[i] for i in sorted(chunks, reverse=True)), []) == [5 + i % 90 for i in range(n)]


def test_chunks_of_parts_are_those_of_the_whole(spark):
    whole = id_rows(spark, 3, 10, 11, 95)
    pieces = whole.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("input_ids") / 7).cast("int")), lambda i: F.slice("input_ids", i * 7 + 1, 7))).alias("part", "input_ids"))
    a = {(r.id, r.chunk): r.input_ids for r in chunk_from_end(whole, size=10).collect()}
    b = {(r.id, r.chunk): r.input_ids for r in chunk_parts_from_end(pieces, "id", size=10).collect()}
    assert a == b


def test_multi_mask_properties(spark):
    rows = mask_multi(id_rows(spark, 48, 49, 254, 300).withColumn("raw", F.col("input_ids")), "id").collect()
    assert {r.id for r in rows} == {49, 254, 300}
    for r in rows:
        body = r.raw[:254]
        plain = [2, *body, 3] + [1] * (254 - len(body))
        masked = [i for i, t in enumerate(r.input_ids) if t == 4]
        assert len(masked) >= 2
        assert [i for i, l in enumerate(r.labels) if l != -100] == masked
        assert [r.labels[i] if l != -100 else r.input_ids[i] for i, l in enumerate(r.labels)] == plain


def test_two_masks_even_if_every_draw_fails(spark):
    rows = mask_multi(id_rows(spark, 60), "id", p=0.0).collect()
    assert [sum(t == 4 for t in r.input_ids) for r in rows] == [2]


def test_token_masks_spare_special_ids_and_do_not_depend_on_partitions(spark):
    df = pad_sequence(spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: (i % 97 + 5).cast("int")).alias("input_ids")))
    rows = mask_tokens(df.withColumn("raw", F.col("input_ids")), "id", 100)
    chosen = specials = kept = masked = 0
    for r in rows.collect():
        for raw, new, label in zip(r.raw, r.input_ids, r.labels):
            if raw < 5:
                specials += label != -100 or new != raw
            elif label == -100:
                assert new == raw
            else:
                assert label == raw
                chosen, kept, masked = chosen + 1, kept + (new == raw), masked + (new == 4)
    assert specials == 0
    assert abs(chosen / 60_000 - 0.1) < 0.01 and abs(masked / chosen - 0.8) < 0.03 and kept / chosen > 0.08
    assert mask_tokens(df.repartition(11), "id", 100).select("id", "input_ids").exceptAll(rows.select("id", "input_ids")).isEmpty()


def test_word_masks_take_whole_words(spark):
    pieces = ["##x", "a", "##b", "##c", "d", "e", "##f"] * 6
    ids = list(range(10, 10 + len(pieces)))
    df = spark.range(200).select("id", F.lit(pieces).alias("pieces"), F.lit(ids).cast("array<int>").alias("input_ids"))
    for r in mask_words(df, "id", 100).collect():
        hits = [label != -100 for label in r.labels]
        for i in range(1, len(pieces)):
            if pieces[i].startswith("##"):
                assert hits[i] == hits[i - 1]


def test_fill_rows_stay_in_line(spark):
    df = spark.createDataFrame([(1, list(range(10, 20)), [7, 8]), (2, list(range(10, 400)), [7, 8, 9]), (3, [], [6])], "id int, history_ids array<int>, target_ids array<int>")
    for r in fill_rows(df).collect():
        m = len(r.target_ids)
        masks = [i for i, t in enumerate(r.input_ids) if t == 4]
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 256
        assert [r.labels[i] for i in masks] == r.target_ids
        assert r.input_ids[masks[-1] + 1] == r.labels[masks[-1] + 1] == 3
        assert sum(l != -100 for l in r.labels) == m + 1
        assert r.input_ids[1 : masks[0]] == r.history_ids[-(254 - m) :]


def test_split_tail_needs_more_than_n_words(spark):
    df = spark.createDataFrame([(1, 0, "a b c d e"), (2, 0, "z a b c d e")], "id int, part int, evnt string")
    assert [(r.id, r.history, r.targets) for r in split_tail(df, "id").collect()] == [(2, "z", list("abcde"))]


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_tails_do_not_depend_on_parts(spark, size):
    """Sequences of 0 to 12 words, whole and in parts."""
    texts = {k: [f"w{k}_{i}" for i in range(k)] for k in range(13)}
    rows = [(k, p, " ".join(w[i : i + size])) for k, w in texts.items() for p, i in enumerate(range(0, max(1, len(w)), size))]
    df = spark.createDataFrame(rows, "id int, part int, evnt string").withColumn("other", F.col("id") * 2)
    got = {}
    for r in split_tail(df, "id").orderBy("id", "part").collect():
        history, targets = got.setdefault(r.id, ([], r.targets))
        history += r.history.split()
        assert targets == r.targets and r.other == 2 * r.id
    assert got == {k: (w[:-5], w[-5:]) for k, w in texts.items() if k > 5}
    for n in (1, 4, 20):
        joined = {r.id: (r.evnt.split(), r.other) for r in join_parts(df, "id", "evnt", n).collect()}
        assert joined == {k: (w[-n:], 2 * k) for k, w in texts.items()}


def test_targets_wider_than_the_row_fail(spark):
    df = spark.createDataFrame([(list(range(5)), list(range(300)))], "history_ids array<int>, target_ids array<int>")
    with pytest.raises(Exception, match="don't fit"):
        fill_rows(df).collect()


def test_composed_and_decomposed_words_are_the_same(spark):
    import unicodedata

    plain = ["각하", "한국어", "é", "Ω", "abc"]
    odd = [unicodedata.normalize("NFD", w) for w in plain[:3]] + ["\u2126", "abc"]
    df = spark.createDataFrame([(1, " ".join(plain)), (2, " ".join(odd))], "id int, evnt string")
    vocab = word_vocabulary(df, min_frequency=2)
    first, second = encode(df, vocab).orderBy("id").collect()
    assert first.input_ids == second.input_ids and 0 not in first.input_ids
    assert [r.input_ids for r in encode_by_join(df, vocab, "id").orderBy("id").collect()] == [first.input_ids] * 2
    letters = spark.createDataFrame([(c, i) for i, c in enumerate(["[UNK]", *"각하한é", "##하", "##국", "##어"])], "piece string, id int")
    pieces = encode(df, letters, subword=True).orderBy("id").collect()
    assert pieces[0].input_ids == pieces[1].input_ids and pieces[0].input_ids[:2] == [1, 5]


def test_words_encode_and_decode(spark):
    df = spark.createDataFrame([(1, "b a a"), (2, " a\n\tb  c "), (3, ""), (4, None)], "id int, evnt string")
    vocab = word_vocabulary(df, min_frequency=2)
    assert {r.piece: r.id for r in vocab.collect()} == {"[UNK]": 0, "[PAD]": 1, "[CLS]": 2, "[SEP]": 3, "[MASK]": 4, "a": 5, "b": 6}
    want = [(1, [6, 5, 5]), (2, [5, 6, 0]), (3, []), (4, [])]
    assert [tuple(r) for r in encode(df, vocab).orderBy("id").select("id", "input_ids").collect()] == want
    assert [tuple(r) for r in encode_by_join(df, vocab, "id").orderBy("id").collect()] == want
    back = decode(encode(df, vocab), vocab).orderBy("id").collect()
    assert [r.pieces for r in back] == [["b", "a", "a"], ["a", "b", "[UNK]"], [], []]


def test_too_big_a_vocabulary_is_not_broadcast(spark):
    """It meets the distinct words in joins, and the result is the same."""
    texts = [(1, "a b a\tcb"), (2, None), (3, ""), (4, "cbab zz bbb \u0065\u0301"), (4, "cbab zz bbb \u0065\u0301"), (5, "é" * 40 + " a")]
    df = spark.createDataFrame(texts, "id int, evnt string")
    pieces = ["[UNK]", "a", "b", "cb", "##a", "##b", "##bb", "c", "é", "##é", "##éé"]
    vocab = spark.createDataFrame([(p, i if i < 1 else i + 4) for i, p in enumerate(pieces)], "piece string, id int")
    for subword in (False, True):
        many, few = (encode(df, vocab, subword=subword, starts="starts", max_pieces=n) for n in (3, 100))
        assert sorted(many.collect(), key=str) == sorted(few.collect(), key=str) and many.columns == few.columns
    unknown = encode(df, vocab, subword=True, max_pieces=3).filter("id = 4").first().input_ids
    assert unknown == [7, 8, 9, 0, 6, 10, 12]


def test_subword_encoding_is_greedy(spark):
    vocab = spark.createDataFrame([("[UNK]", 0), ("un", 5), ("##aff", 6), ("##able", 7), ("a", 8), ("##a", 9)], "piece string, id int")
    df = spark.createDataFrame([(1, "unaffable a unax " + "a" * 1500)], "id int, evnt string")
    assert encode(df, vocab, subword=True).first().input_ids == [5, 6, 7, 8, 0, 8, *[9] * 1499]


def test_bigram_model_and_chain(spark):
    df = spark.createDataFrame([(1, 0, "a b a c"), (1, 1, "c b"), (2, 0, "a b")], "k int, part int, evnt string")
    got = {r.prev: (r.next, r.n) for r in next_event_model(df, "k").collect()}
    assert got == {"a": ("b", 2), "b": ("a", 1), "c": ("b", 1)}
    model = next_event_model(df, "k")
    rows = spark.createDataFrame([(1, "x a"), (2, "q")], "id int, history string")
    filled = {r.id: r.preds for r in fill_next(model, rows, n=3).collect()}
    assert filled == {1: ["b", "a", "b"], 2: [None] * 3}


def test_scorer_is_made_once_per_task(spark):
    def make_scorer():
        made = []

        def scorer(batch):
            made.append(1)
            return batch.assign(calls=len(made))

        return scorer

    rows = score(spark.range(30_000).coalesce(1), make_scorer, "id long, calls long").collect()
    assert len(rows) == 30_000 and max(r.calls for r in rows) == 3
