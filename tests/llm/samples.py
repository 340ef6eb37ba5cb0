import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns with names that operators use themselves.
CLASHING = ("size", "kept", "row", "block", "id", "part", "spans", "component_id", "features", "version", "fp", "target", "s_text", "q_text", "t_text", "text_")


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    syllables = ["an", "er", "the", "in", "ou", "st", "re", "ti", "ha", "li"]
    pool = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    out = [rng.choice(pool) for _ in range(words)]
    return " ".join(w.capitalize() + "." if i % 11 == 10 else w for i, w in enumerate(out))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    same = prose(1, 120)
    return [
        (1, same, "en", "a", 1), (1, same, "en", "a", 1), (2, same, "en", "b", None), (3, same + " tail", "en", "a", 3),
        (4, None, None, None, None), (5, "", "fr", "a", 0), (6, " \n\t ", "fr", "", 3), (7, "word", "de", "a", 4),
        (2**62 + 1, "short", "en", "a", 1), (None, prose(2, 200), "en", "b", 9), (None, None, "en", "b", None), (8, "\n".join(["Row of words here"] * 40), "de", None, 1),
        (9, prose(3, 20_000), "en", "c", 1), (10, "aaaa" * 2_000, None, "c", 1), (11, "é漢  x́ ½ ²" * 60, "fr", "c", 1), (100, "12 34 !!", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def collected(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
