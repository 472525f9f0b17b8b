"""Odd tables that every corpus operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASH = {"score": "1", "row": "2", "fp": "'x'", "component_id": "3", "size": "4", "target": "5", "label": "6", "key": "'k'", "block": "7", "n": "8", "word": "'w'", "_row": "9", "part": "10", "h": "11", "_size": "'mine'", "_k": "12", "_times": "13", "_n": "14", "mix_row": "15", "MIX_TIMES": "16", "near_key": "17"}

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i) % len(WORDS)] + str((seed * i) % 5) for i in range(n))


def odd_rows():
    long = text(1, 30000)
    rows = [(1, text(3, 80)), (2, text(3, 80)), (3, text(3, 79) + " tail"), (4, None), (5, ""), (6, long), (7, "Ünïcödé ＡＢＣ \x00   漢字 " + text(9, 40)), (8, "   \n\t "), (9, text(3, 80)), (9, text(3, 80)), (10, text(11, 60)), (10, text(12, 60)), (None, text(3, 80)), (None, text(13, 50)), (11, "x"), (12, "a" * 5000)]
    return [(i, t, None if k % 4 == 0 else ("en", "fr")[k % 2], None if k % 5 == 0 else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), DOCS).repartition(3)
    return df.selectExpr("*", *(f"{v} AS {k}" for k, v in CLASH.items())).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
