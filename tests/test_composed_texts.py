"""Which texts are handed to the normal form."""

import re
import unicodedata

from pyspark.sql import functions as F

from strandline.operators.vocabulary import PERHAPS_DECOMPOSED, composed, word_counts

TEXTS = ["", "plain", "line\nbreak\r\n ", "déjà vu", "déjà", "가나", "가", "漢字 ", "x😀", "ΩΩ", "あ゙", "tab\ẗ́"]


def test_a_match_of_the_whole_text_finds_what_the_search_finds(spark):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate([*TEXTS, None])], "n int, text string")
    got = {r.n: r.text for r in rows.select("n", composed(F.col("text")).alias("text")).collect()}
    assert got == {n: t and unicodedata.normalize("NFC", t) for n, t in enumerate([*TEXTS, None])}
    assert any(re.search(PERHAPS_DECOMPOSED, t) for t in TEXTS)
    plan = word_counts(rows, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "[^\\u0000" not in plan and "\\A[\\u0000" in plan  # a search took 20 times as long


def test_words_of_either_form_are_one_word(spark):
    rows = spark.createDataFrame([("été x",), ("été x",), (None,), ("été",)], "text string")
    assert {r.word: r.freq for r in word_counts(rows, "text").collect()} == {"été": 3, "x": 2}
