import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and columns that clash."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta's", "ñandú", "ö", "42", "it's.", "<|endoftext|>", "漢字", "é", "x-y", "’", "can't"]
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "no id here", None, "b", 10), (None, "no id here", None, "b", 10)]
    base = [rng.choice(words) for _ in range(400)]
    for k in range(10, 40):
        own = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 200])):
            own[rng.randrange(400)] = rng.choice(words)
        rows.append((k, " ".join(own), "en", rng.choice("ab"), 1))
    rows += [(40, "x " * 30000, "en", "a", 5), (41, "\n".join(["same line here"] * 50), "de", None, 5), (12, "again", "en", "a", 1), (12, "again", "en", "a", 1)]
    rows += [(50 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 900))), "en", "b", 1) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("hash", "ids", "length", "part", "fp", "mask", "score", "start", "block", "n", "key", "_kept", "n_entities", "_mentions", "_score", "_tries", "_text", "payload", "string", "band"):
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df.repartition(5)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
