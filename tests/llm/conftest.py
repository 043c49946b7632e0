import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, h long"


@pytest.fixture(scope="session")
def corpus():
    """Documents with exact and near copies, shared passages, hard cases in every column, and clashing extra columns."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(120)
    rows = [(i, text(rng.randint(1, 90)), "en", f"s{i % 5}") for i in range(40)]
    rows += [(40 + i, f"{text(20)} {passage}\n{text(15)}", "de", "hot") for i in range(12)]
    rows += [(60 + i, base, "fr", None) for i in range(8)]
    for i in range(12):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "zz" + str(rng.random())[2:6]
        rows.append((80 + i, " ".join(w), None, "hot"))
    rows += [(200, None, None, None), (201, "", "en", "hot"), (202, " \t\n", "en", "hot"), (203, "solo", "es", "s1"), (204, "Solo", "es", "s1")]
    rows += [(205, "la " * 500, "es", "hot"), (206, text(6000), "en", "hot"), (-3, base.upper(), "en", "s2"), (207, "éà 日本語 ß 😀\x0bx", "fr", "s3")]
    rows += [(208, "a b", None, "s3"), (None, passage, "en", "s3"), (210, rows[3][1], "en", "s3")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame([(*r, len(r[1] or ""), "clash", 1) for r in corpus], SCHEMA)
    return df.repartition(5)


def null_last(x):
    return (x is None, x)
