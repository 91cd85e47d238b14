"""A small table of hard documents: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, t string, h long, node long, size long, source_key string, keys string, id string"


def words(rng, n, bag):
    return " ".join(rng.choice(bag) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    rng = random.Random(11)
    en = ["the", "thing", "ation", "ing", "other", "with", "there", "ever", "ness", "well"] + [f"th{c}{v}" for c in "bcdfg" for v in "aeiou"]
    de = ["der", "schung", "keit", "und", "über", "ein", "nicht", "ß", "äu", "pf"] + [f"sch{c}{v}" for c in "bkltz" for v in "äöüei"]
    shared = words(rng, 60, en)
    rows = []
    for i in range(60):
        lang, bag = ("en", en) if i % 3 else ("de", de)
        lines = [words(rng, rng.randint(3, 60), bag) for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), "  The And ATTION to thanedble the, anea.\t")
        if i % 5 == 0:
            lines.append(shared)
        rows.append((i * 3, "\n".join(lines), lang, f"s{i % 4}" if i % 2 else "hot"))
    base = rows[10][1]
    for n in range(6):  # near copies
        w = base.split(" ")
        w[3 + n] = "changed"
        rows.append((1000 + n, " ".join(w), rows[10][2], "hot"))
    rows += [(2000 + n, base, rows[10][2], "hot") for n in range(5)]  # exact copies
    rows += [
        (3000, None, None, None), (3001, "", "en", None), (3002, " \n\t\n", "en", "s1"), (3003, "12 %% 34", "en", "s1"), (None, "an id is missing here and there", "en", "s2"),
        (3004, words(rng, 20_000, en), "en", "s3"), (3005, "é" * 9, "de", "s3"), (3006, "É" * 30 + "\n" + "É" * 30, "de", "s3"), (3007, "x" * 300, "en", "s3"), (3008, "one", None, "s3"),
        rows[7], rows[7],
    ]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame([(*r, None, 1, "t", 2, 3, 4, "k", "k", "id") for r in hard_rows], SCHEMA).repartition(3)
