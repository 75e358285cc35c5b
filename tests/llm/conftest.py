import random

import pytest

from pyspark.sql import types as T

#: Extra columns whose names the operators use themselves.
CLASHING = ("mark", "h", "key", "component", "rep", "band", "row", "kept", "line", "size", "times", "pattern", "removed", "spans", "label", "score", "n", "cls", "item_id", "words")


def sentence(rng, words):
    return (" ".join("".join(rng.choice("abcdeioutrs") for _ in range(rng.randint(2, 7))) for _ in range(words)) + ".").capitalize()


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(4)
    base = "\n".join(sentence(rng, 12) + " " + sentence(rng, 9) for _ in range(8))
    long_ = " ".join(sentence(rng, 15) for _ in range(2500))
    near = base.replace(" ", " x ", 1)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, near, None, "a"), (3, near, None, "a"), (4, None, "en", None), (5, "", None, None),
        (6, "two words", "en", "a"), (7, long_, "en", "a"), (None, base, "en", "a"), (8, "\n \n\t", "en", "a"), (9, "É ünï 😀 " * 30, "de", "c"), (10, sentence(rng, 80), "en", "b"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Documents with nulls, empty, short and long texts, ties, repeated rows, and columns with clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           *(T.StructField(c, T.StringType()) for c in CLASHING)])
    return spark.createDataFrame([(*r, *("z" for _ in CLASHING)) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def labelled(spark):
    return spark.createDataFrame([(1, 1), (2, 1), (10, 0), (7, 1), (None, 1), (9, None), (6, 0)], "doc_id long, label int")


@pytest.fixture(scope="session")
def bench_items(spark, odd_rows):
    words = odd_rows[7][1].split()
    return spark.createDataFrame([(1, " ".join(words[5000:5040])), (2, None), (3, ""), (4, "two words"), (5, "nowhere to be seen in any of these texts at all")], "item_id long, text string")
