import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, pos int, size long, g long, shard int, score double, copy long, spans string, _text string"


def made_texts(seed=3):
    """Texts with copies, shared passages, near copies, empty, null and very long ones."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abdeghilmnorstuw") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(stock) for _ in range(n))

    passage, line = prose(60), prose(14)
    whole = prose(120)
    texts = [whole, whole, prose(90) + "\n" + passage + "\n" + prose(30), passage, prose(40) + " " + passage, None, "", "   \n\t ", "É Über", "x"]
    texts += [line + "\n" + prose(70) for _ in range(8)]
    near = prose(300).split()
    for i in range(12):
        own = list(near)
        own[i * 7] = f"new{i}"
        texts.append(" ".join(own))
    texts += [prose(9000), (prose(50) + "\n") * 3, "Released under the MIT License.\n" + prose(60), "Licensed under the Apache License, Version 2.0. mit license MIT LICENSE " + prose(30)]
    texts += [whole] * 5 + ["ab " * 200, prose(2) * 60, "naïve café " * 40]
    return texts


@pytest.fixture(scope="session")
def texts():
    return made_texts()


@pytest.fixture(scope="session")
def rows(texts):
    out = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The texts with ids, and columns whose names the operators use inside."""
    wide = [(i, t, "en", "src", len(t or ""), "w", 1, 2, 3, 4, 0.5, 6, "s", "t") for i, t in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark):
    """Rows that repeat whole, that share an id only, and without an id."""
    long = "the quick brown fox jumps over the lazy dog and runs away from here " * 4
    rows = [(7, long), (7, long), (7, "other " + long), (None, long), (None, None), (8, "mit license")]
    return spark.createDataFrame([(i, t, "en", "s", 1, "w", 1, 2, 3, 4, 0.5, 6, "s", "t") for i, t in rows], SCHEMA)
