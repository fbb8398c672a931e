import random

import pytest

#: Columns of other tables' names, which no operator may trip over.
CLASHES = {"id": 1, "fp": 2, "n": 3, "key": "k", "part": 4, "terms": "t", "score": 0.5, "shard": 6, "digest": "d", "start": 7, "node": 8, "list": 9, "_row": 10, "label": 11}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(draw, n, vocabulary):
    return " ".join(draw.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def vocabulary():
    draw = random.Random(11)
    return ["".join(draw.choice("abcdefghilmnoprstuv") for _ in range(draw.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(vocabulary):
    """Nulls in any column, empty and white texts, repeats, copies, near copies, other scripts and a very long text."""
    draw = random.Random(12)
    texts = [words(draw, draw.randint(1, 300), vocabulary) for _ in range(30)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n\t ", "en", "a", 4), (103, None, "en", "a", None)]
    rows += [(110 + i, texts[0], "en", "a", len(texts[0])) for i in range(5)]
    rows += [(120, texts[1].replace(" ", "  ", 1), "en", "a", 1), (121, texts[1].upper(), "en", "a", 1), (5, texts[5], "en", "a", len(texts[5])), (5, texts[5], "en", "a", len(texts[5]))]
    rows += [(130, "日本語 text — ünïcödé, İstanbul", "xx", "b", 1), (131, "a <|endoftext|> b<|startoftext|>", "en", "b", 1), (132, "it's  'tis  12²\x85x\xa0y\x1cz", "en", "b", 1)]
    rows += [(140, words(draw, 30_000, vocabulary), "en", "c", 1), (141, "".join(draw.choice("abcd") for _ in range(40_000)), "en", "c", 1)]
    rows += [(None, texts[2], None, None, None), (None, None, None, None, None), (None, texts[0], None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with clashing extra columns."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, SCHEMA).withColumns({c: F.lit(v) for c, v in CLASHES.items()}).repartition(3).cache()


@pytest.fixture(scope="session")
def clashes():
    return CLASHES


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
