import random

import pytest

WORDS = ["".join(random.Random(n).choices("abcdeéfgh", k=1 + n % 7)) for n in range(400)]
EXTRA = "kept boolean, print string, component_id string, score string, shard string, n string, predicted string"


def sentence(draw: random.Random, low: int, high: int) -> str:
    return " ".join(draw.choices(WORDS, k=draw.randint(low, high))) + "."


def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, near copies, ties, a repeated row."""
    draw = random.Random(3)
    base = [sentence(draw, 20, 90) for _ in range(40)]
    rows = [(n, text, "en", f"src{n % 7}") for n, text in enumerate(base)]
    rows += [(100 + n, base[n] + " ", "de", "src0") for n in range(6)]
    rows += [(110 + n, base[n].replace(" ", "\n", 1), None, None) for n in range(3)]
    rows += [(120, None, "en", "src1"), (121, "", "en", "src1"), (122, " \t\n", None, "src2"), (None, base[5], "en", None)]
    rows += [(130, base[7] + sentence(draw, 1, 2), "en", "src3"), (131, "Tab\tand  double  spaces. " * 3, "fr", "src4")]
    long = " ".join(sentence(draw, 50, 60) for _ in range(900))
    rows += [(140, long, "es", "src5"), (141, long + " end", "es", "src5"), (142, "x" * 30_000, "es", "src6")]
    return rows + [(3, base[3], "en", "src3"), (200, "one", "en", "src1"), (201, "one two", "en", "src1"), (202, "ONE", "en", "src1")]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with further columns named like results."""
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
    return spark.createDataFrame([(*row, None, *[None] * 7) for row in odd_rows()], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
