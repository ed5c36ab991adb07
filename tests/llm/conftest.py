"""Documents with every odd case that the operators must survive."""
import random

import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "stone", "river", "moves", "under", "old", "light", "and", "bridges", "keep", "their", "names"]) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """(doc_id, text) and columns whose names the operators use inside."""
    a, b = prose(1, 80), prose(2, 120)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "three short words"), (5, LONG), (6, a), (7, a), (8, a), (8, a), (9, b), (10, b + " one more"),
            (11, "Ünïcödé ßtraße 日本語 тест " + prose(3, 60)), (None, prose(4, 70)), (12, "5 6 7 ... !!"), (13, a + "\n" + b), (14, "x " * 400), (15, None)]
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "h", 2, 3, "f") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, n int, hash string, start int, shard int, feature string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
