"""Documents with every odd case: nulls, empty and long texts, repeated rows, ties, and extra columns with clashing names."""

import random

import pytest

WORDS = [f"word{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "\n" if r.random() < 0.05 else "") for _ in range(n))


def cases() -> list[tuple]:
    passage = prose(99, 120)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, prose(5, 300)), (6, prose(5, 300)), (7, prose(7, 100) + " " + passage + " " + prose(8, 100)), (8, passage + prose(9, 50))]
    rows += [(9, prose(5, 290) + " " + prose(10, 10)), (10, "Ünïcode ßtraße Σίσυφος ΣΑΣ 日本語テキスト 😀 naïvé <|endoftext|> x\r\ny"), (10, "Ünïcode ßtraße Σίσυφος ΣΑΣ 日本語テキスト 😀 naïvé <|endoftext|> x\r\ny")]
    rows += [(11, prose(11, 6000)), (11, prose(12, 40)), (12, "ab" * 700), (13, "The same line of words here again.\n" * 4), (None, prose(13, 60)), (None, None), (-5, prose(7, 100)), (14, "x" * 3000), (15, "don't it's 123abc ... !!! a_b"), (16, passage)]
    rows += [(9007199254740993, prose(14, 80)), (9007199254740995, prose(14, 80)), (-9223372036854775807, prose(15, 30)), (17, "y" * 400 + "\n"), (18, None)]
    return [(i, t, "en", f"src{n % 3}", len(t or ""), "k", 1, "a", 2, "b", 3.0) for n, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, th int, score string, _th int, _id string, _spans double"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(cases(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows):
    return sorted([tuple(r) for r in rows], key=str)
