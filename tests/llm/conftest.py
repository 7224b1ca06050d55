import random

import pytest
from pyspark.sql import functions as F

#: Names that operators use inside; as extra columns they must do no harm.
CLASHING = ("mark", "node", "bucket", "part", "place", "label", "words", "low", "key", "n", "word", "shard", "toxic_score", "n_tokens", "pivot")


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    long = " ".join(word() for _ in range(60_000))
    return [
        (1, None),
        (2, ""),
        (3, " ".join(base)),
        (4, " ".join(near)),
        (5, " ".join(base)),
        (6, f"intro {word()}\n{passage}\nend {word()}"),
        (7, f"other {word()}\n{passage}\nmore {word()}"),
        (8, long),
        (9, "!!! ..."),
        (10, "Été à Zürich 10½ <|endoftext|> ok  two  spaces\n\n\nend "),
        (10, "Été à Zürich 10½ <|endoftext|> ok  two  spaces\n\n\nend "),
        (10, "same id, other text under the MIT license"),
        (None, "a row without an id, apache license version 2 and CC BY-NC 4.0"),
        (None, None),
        (11, "a"),
        (12, "aaaa" * 100),
        (13, "Licensed under the Apache License, Version 2.0.\nplain line"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in odd_rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("doc_id < 0")


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
