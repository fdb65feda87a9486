import random

import pytest

SYLLABLES = "ka lo mi ren tas ul ver wen xo yp zar dor fel gim hon jat".split()


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return lambda n: " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark, words):
    """Rows with nulls, empty and long texts, exact and near copies, shared passages, repeated rows, odd spaces; a clashing extra column."""
    passage, base = words(60), words(120)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One two"), (5, "one  two"), (6, words(9000)), (7, base), (8, base), (9, base.replace(" ", "\n")), (10, base.upper())]
    rows += [(11 + i, f"{words(30)} {passage} {words(20 + i)}") for i in range(8)]
    near = base.split()
    rows += [(20 + i, " ".join([*near[: 10 * i + 5], "changed", *near[10 * i + 6 :]])) for i in range(8)]
    rows += [(30, words(34)), (31, words(35)), (32, f"{passage} {passage}"), (33, "é ü 漢字 naïve\xa0x don't 'tis 12,5 ½"), (34, "x" * 5000), (7, base)]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, prefix string")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("1 = 0")
