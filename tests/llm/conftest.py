import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, found string, fp string, length int, n_words string, copies int"


def documents(seed: int = 5, n: int = 160) -> list[tuple]:
    """Documents with nulls, empty, blank and very long texts, copies, near copies, repeated rows and clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopéü") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    word = lambda: rng.choice(vocabulary)
    passage = "\n".join(" ".join(word() for _ in range(14)) + "." for _ in range(6))
    rows = []
    base = " ".join(word() for _ in range(120))
    for i in range(n):
        kind = i % 10
        text = " ".join(word() + ("\n" if rng.random() < 0.08 else "") for _ in range(rng.randint(20, 200)))
        if kind == 1:
            text = base
        elif kind == 2:
            parts = base.split()
            parts[rng.randrange(120)] = word()
            text = " ".join(parts)
        elif kind == 3:
            text = text + "\n" + passage + "\n" + " ".join(word() for _ in range(30))
        elif kind == 4 and i % 20 == 4:
            text = [None, "", " \n\t ", "one", "a b c", "x\x1cy\x85z"][i // 20 % 6]
        elif kind == 5 and i % 50 == 5:
            text = " ".join(word() for _ in range(6000))
        elif kind == 6:
            text = (" ".join(word() for _ in range(6)) + " ") * 12
        source = None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}"
        rows.append((i, text, None if i % 7 == 0 else "en", source, len(text) if text else None, "x", 3, "y", None, 1, None, 9))
    rows += [rows[1], rows[1], rows[12], rows[7]]
    rows.append((None, "no id " * 30, None, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
