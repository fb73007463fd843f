import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp string, base_spans string, keep string, media string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed=0):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def odd_rows():
    long = prose(30_000, 5)
    texts = [None, "", " \n\t ", "one", "two words", long, long, prose(80, 1), prose(80, 1), prose(80, 2) + " mail a.b@c.example.org or +1 (212) 555-0100", "é" * 3000, "7" * 30_000, "a" * 40_000, '<|endoftext|> token = "0123456789abcdef0123456789abcdef01234567"', "▁ odd ▁▁ mark"]
    rows = [(i, t, "en", "src", len(t or ""), 1, "x", "y", "z", "m") for i, t in enumerate(texts)]
    return rows + [rows[7], (None, "null id " + prose(60, 9), None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)
