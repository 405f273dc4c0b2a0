import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, uid int, _row int, label string"


def make(spark, rows):
    """rows: (doc_id, text[, lang]); the extra columns have names that operators use inside."""
    full = [(i, t, (r + ("en",))[2] if len(r := (i, t, *rest)) < 3 else r[2], "s", None if t is None else len(t), "x", "y", 1, 2, "z") for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """Null, empty, wordless, very long, repeated, tied and near-equal rows."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(6, 120))) for _ in range(40)]
    rows = [(1, None), (2, ""), (3, "!!! ... ###"), (4, "one"), (5, "one two three"), (6, "one two three"), (None, "a text without an id, of some words"), (7, " ".join(rng.choice(vocab) for _ in range(30_000)))]
    rows += [(8, "x" * 20_000), (8, "x" * 20_000), (9, "日本語 テキスト 😀 naïve Ärger")]
    for k, text in enumerate(base):
        rows.append((100 + k, text))
        words = text.split()
        for m in range(rng.randint(0, 4)):
            w = list(words)
            w[rng.randrange(len(w))] = "changed"
            rows.append((1000 + 10 * k + m, " ".join(w)))
    rows += [(5000 + k, base[0]) for k in range(60)]  # a hot text
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return make(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [(1, "a")]).where(F.lit(False))
