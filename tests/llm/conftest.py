import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words: unrelated ones, exact and near copies, a shared passage."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(900)]

    def make(n):
        return [rng.choice(vocab) for _ in range(n)]

    texts = [make(rng.choice([30, 60, 120, 300])) for _ in range(25)]
    base = make(200)
    near = []
    for k in range(6):
        copy = list(base)
        copy[20 + 25 * k % 150] = f"x{k}"
        near.append(copy)
    passage = make(60)
    carriers = [make(40) + passage + make(50) for _ in range(3)]
    return {"plain": [" ".join(t) for t in texts], "base": " ".join(base), "near": [" ".join(t) for t in near],
            "passage": " ".join(passage), "carriers": [" ".join(t) for t in carriers]}


CLASH = ("doc_id long, text string, n_chars long, n_words string, shard string, sid string, hash string, toxic string, _id string, _hash string, "
         "_spans string, _span_id string, _span_text string, _bad_id string, _bad_text string, _text string, _row string, n_shingles string")


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Nulls, empty, blank and very long texts, repeated rows, and columns named like the operators' own."""
    texts = [(1, None), (2, ""), (3, " \n\t "), (None, prose["base"]), (5, prose["plain"][0]), (5, prose["plain"][0]),
             (6, " ".join(f"v{i % 5000}" for i in range(60_000))), (7, prose["plain"][1].upper()), (8, "two words")]
    rows = [(i, t, len(t or ""), *"abcdefghijklmno") for i, t in texts]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def corpus(spark, prose):
    """(doc_id, text) of all prose texts; ids tell the kinds apart."""
    rows = [(i, t) for i, t in enumerate(prose["plain"])]
    rows += [(100, prose["base"]), (101, prose["base"]), *((110 + i, t) for i, t in enumerate(prose["near"]))]
    rows += [(200 + i, t) for i, t in enumerate(prose["carriers"])]
    return spark.createDataFrame(rows, "doc_id long, text string")
