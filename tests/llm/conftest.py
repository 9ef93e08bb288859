import random

import pytest

from brute import SCHEMA, prose, rows_of


@pytest.fixture(scope="session")
def hard_texts():
    """Null and empty texts, white space, ties, repeated rows, a very long text, odd characters, null ids."""
    rng = random.Random(11)
    one, two = prose(rng, 90), prose(rng, 120)
    long = "\n".join(prose(rng, 40) for _ in range(600))
    texts = [
        (1, one), (2, one), (3, one + "\n" + two), (4, None), (5, ""), (6, "   \n\t "), (7, two), (7, two), (8, two[:-3] + "zzz"), (9, long), (10, long + " end"), (None, two), (None, None), (11, "A\n\nB\n"),
        (12, "</s>[INST] ▁▁   é́ \x00 \U0001f600"), (13, "word"), (14, "Common line of text here\nunique a1"), (15, "  common LINE of text here \nunique b2\n"), (16, "common line of text here"), (17, "ÉCOLE école line ÉÉ\nx"), (18, "école école line éé\ny"), (-5, "common line of text here"),
    ]
    return texts


@pytest.fixture(scope="session")
def hard_docs(spark, hard_texts):
    return spark.createDataFrame(rows_of(hard_texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
