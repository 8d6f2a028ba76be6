import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h int, fp string, row int, blobs int, _th int, bad string"


def rows_of(texts):
    return [(i, t, "en" if n % 2 else "fr", f"site{n % 13}", len(t or ""), "x", 1, "f", 2, 3, 4, "b") for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and blank texts, exact and near copies, shared passages, one very long text, repeated ids."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ti", "on", "er", "th", "an", "é", "st"]) for _ in range(r.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, line = say(40), "All rights reserved by this very site."
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One TWO"), (6, "\x00\x1c\x85 a\xa0b"), (7, "日本語 テスト ½ ²"), (8, "a" * 3000)]
    base = say(200)
    out += [(10 + i, base) for i in range(4)]
    out += [(20 + i, base.replace(base.split()[i + 3], "changed", 1)) for i in range(12)]
    out += [(40 + i, f"{say(30)}\n{line}\n{say(10)} {passage} {say(25)}") for i in range(26)]
    out += [(80, say(30_000)), (81, "idiot scum " * 5), (4, "one"), (4, "another text"), (None, base), (None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
