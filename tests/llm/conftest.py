from __future__ import annotations

import random

import pytest

WORDS = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "pra", "sto") for b in ("ne", "ri", "tal", "ux", "den", "ff")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASH = ["score", "sig", "length", "piece", "anchor", "kind", "size", "range", "spans", "shard", "owner", "taken", "n", "rank", "offset"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple]:
    """Exact and near copies, a shared passage, ties, nulls, empty, blank, short and long texts, a repeated row."""
    rng = random.Random(7)
    passage = sentence(rng, 70)
    long = sentence(rng, 9000)
    base = sentence(rng, 200)
    near = base.split(" ")
    near[100] = "changed"
    texts = [base, " ".join(near), base.replace(" ", "  "), None, "", " \n\t", "one", "one two", "éa 中文 ﬁx STRASSE straße", long]
    texts += [f"{sentence(rng, 40)} {passage} {sentence(rng, rng.randint(1, 60))}" for _ in range(12)]
    texts += [sentence(rng, rng.randint(1, 120)) for _ in range(25)]
    texts += [base, long, sentence(rng, 13), sentence(rng, 12), "a b " * 300]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s1", None][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[11]]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="session")
def null_ids(spark, rows):
    return spark.createDataFrame([(None, *r[1:]) if r[0] % 5 == 0 else r for r in rows], COLUMNS)
