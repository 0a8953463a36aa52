"""Rows that are hard on the operators."""

import random

import pytest


def words(r: random.Random, n: int) -> str:
    """n made-up words."""
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and columns whose names clash."""
    r = random.Random(3)
    base = words(r, 120)
    long = "\n".join(words(r, 200) for _ in range(60))
    rows = [(i, words(r, r.randint(1, 80)) + "\n" + words(r, 12), ["en", "fr"][i % 2], ["a", "b", None][i % 3], 5, 1, "row") for i in range(40)]
    rows += [(50, base, "en", "a", 1, 1, "x"), (51, base, "en", "a", 1, 1, "x"), (52, base.replace(base.split()[60], "changed"), "en", "b", 1, 1, "x")]
    rows += [(60, None, None, None, None, None, None), (61, "", "en", "a", 0, 0, ""), (62, "", "fr", "b", 0, 0, ""), (63, " \t\n \n", "en", "a", 0, 0, "")]
    rows += [(70, long, "en", "a", 9, 1, "x"), (71, "ünï çødé €\n日本語 <|endoftext|> a\rb", "de", "é", 9, 1, "x")]
    rows += [rows[0], rows[0], (None, "no id here at all", "en", "a", 1, 1, "x"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_row` long, row string").repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(messy):
    """The same columns without rows."""
    return messy.limit(0)
