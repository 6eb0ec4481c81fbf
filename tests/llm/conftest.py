import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with nulls, empties, ties, near copies, repeated ids and one very long text."""
    import random

    rng = random.Random(11)
    base = [" ".join(rng.choice(WORDS) for _ in range(120)) for _ in range(12)]
    near = []
    for t in base[:6]:
        for k in range(4):
            w = t.split()
            w[10 + 7 * k] = f"edit{k}"
            near.append(" ".join(w))
    passage = " ".join(f"shared{i}" for i in range(60))
    sharing = [passage + " " + " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(150)) for _ in range(15)]
    edge = [None, "", "   ", "one", "One", "two words", "a b c d e", "A B C D E", "x" * 5000, "é ü ß " * 40, "\U0001f600 " * 30, " ".join(WORDS * 3000)]
    all_ = base + base[:3] + near + sharing + edge
    rows = list(enumerate(all_))
    return [*rows, (0, base[0]), (5, "an id that comes twice"), (None, base[1]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table, with other columns whose names operators use inside."""
    rows = [(i, t, f"s{(i or 0) % 3}" if i != 7 else None, n, 1, 2) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, k int, n int, label int").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
