import random

import pytest

SYLLABLES = ["an", "er", "th", "ing", "on", "re", "ti", "é", "sch", "ñ"]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def edited(rng, text, share):
    own = text.split(" ")
    for i in range(len(own)):
        if rng.random() < share:
            own[i] = "changed" + str(rng.random())
    return " ".join(own)


def corpus(seed=5, n=120):
    """doc_id, text, lang, source: plain texts, exact and near copies, short, empty, null, white and very long ones."""
    rng = random.Random(seed)
    rows = []
    passage = " ".join(words(rng, 30))
    for i in range(n):
        text = " ".join(words(rng, rng.choice([3, 8, 40, 200])))
        if i % 7 == 3 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif i % 7 == 4 and rows:
            text = edited(rng, rows[rng.randrange(len(rows))][1] or "", rng.choice([0.01, 0.03]))
        elif i % 7 == 5:
            text = passage + " " + text
        elif i % 7 == 6:
            text = text.upper() if i % 2 else text.replace(" ", "  \t")
        rows.append((i, text, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][min(i % 9, 3)]))
    long_ = " ".join(words(rng, 30_000))
    rows += [(n, None, "en", "s1"), (n + 1, "", "en", "s1"), (n + 2, " \t\n ", None, "s2"), (n + 3, long_, "en", "s2"), (n + 4, long_ + " end", "en", None), (n + 5, "x" * 50_000, "de", "s1")]
    rows += [(n + 6, "<|endoftext|> a  b <|endoftext|>", "en", "s3"), (n + 7, "one\r\ntwo\n\n three \x1c 　 \U0001f600 ", "en", "s3")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null keys, repeated rows, and columns that are named like those of the operators."""
    text = "a b c d e f g h i j k l"
    rows = [(1, text, "en", "s", 1, 2, "x"), (1, text, "en", "s", 1, 2, "x"), (None, text, None, None, None, None, None), (None, None, "en", "s", 3, 4, "y"), (2, "", "en", "s", 3, 4, "y"), (1, "z", "en", "s", 1, 2, "x")]
    return spark.createDataFrame(rows, SCHEMA + ", kept int, score int, _key string").selectExpr("*", "score AS n_tokens", "_key AS node", "kept AS size", "kept AS copies", "_key AS _gone", "_key AS _w", "_key AS _sha", "_key AS ids")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
