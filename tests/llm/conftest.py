import random

import pytest

#: columns that clash with names the operators use inside
CLASH = "n long, h1 long, h2 long, bands string, key string, body string, kept string, score string, k1 string, rid string, component string, label string, v string"


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def edge_rows(vocabulary):
    """(doc_id, text): null and empty texts, white space only, one word, a very long
    text, a repeated row, a null id, an emoji and a control character, ties."""
    rng = random.Random(9)
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    plain = " ".join(rng.choice(vocabulary) for _ in range(60))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "Word"), (5, long), (6, plain), (6, plain), (7, plain), (None, plain), (None, None),
            (8, "Ünï \U0001f600 \x01 a<|endoftext|>b  İSTANBUL"), (9, plain.upper()), (-3, "Word")]


def with_clashes(spark, rows, schema="doc_id long, text string"):
    """The rows with further columns of clashing names, all null."""
    df = spark.createDataFrame(rows, schema)
    extra = [c.strip().split(" ") for c in CLASH.split(",")]
    return df.selectExpr("*", *(f"cast(null as {t}) as {c}" for c, t in extra if c not in df.columns))


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return with_clashes(spark, edge_rows).cache()


@pytest.fixture(scope="session")
def clashes():
    return with_clashes
