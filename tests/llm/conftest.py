"""A small table with the awkward cases: nulls, empty and long texts, copies, clashing columns."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, ids int, quality string"


def make_documents() -> list[tuple]:
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7))) for _ in range(400)]

    def text(n: int) -> str:
        parts = [rnd.choice(words) for _ in range(n)]
        for i in range(12, n, 13):
            parts[i] += ".\n"
        return " ".join(parts)

    texts: list = [None, "", " ", "\n\t\n", "one", "Ünï çödé 日本 \x85  x", "a  b   c \n\n d ", "don't  we'll 12 ½ ²"]
    texts += [text(rnd.randint(1, 120)) for _ in range(40)]
    base = text(150)
    for _ in range(12):  # near copies of one text
        parts = base.split(" ")
        for _ in range(rnd.randint(1, 6)):
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
        texts.append(" ".join(parts))
    texts += [base, base.replace(" ", "\t"), base.replace(" ", "  "), base]
    texts += [text(9000), "z" * 3000, "ab " * 500, text(30) + "\n" + text(8) * 3]
    texts += [
        'x password="hunter2hunter2" y', "AKIA" + "A1B2C3D4E5F6G7H8 token: short", "0123456789abcdef" * 3,
        "key ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5z0 end", "id 123e4567-e89b-12d3-a456-426614174000",
    ]
    rows = [
        (i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s1", None]), len(t) if t else None, "x", i, "q")
        for i, t in enumerate(texts)
    ]
    rows += [rows[20], rows[20], (None, texts[21], None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None)] * 2
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
