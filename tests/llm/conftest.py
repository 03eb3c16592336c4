import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for folder in (HERE, os.path.dirname(HERE), os.path.dirname(os.path.dirname(HERE))):
    if folder not in sys.path:
        sys.path.insert(0, folder)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def docs(spark):
    """doc_id, text, lang, source and columns whose names the operators use inside."""
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines), rng.choice(["en", "fr"]), f"src{i % 5}"))
    for i in range(60, 85):  # copies and near copies of one document, a hot group
        words = (passage + " " + passage[::-1] + " " + rows[3][1]).split(" ")
        if i % 3:
            words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words), "en", "src0"))
    for i in range(85, 95):  # one passage in otherwise different documents
        rows.append((i, rows[i - 60][1] + "\n" + passage, "fr", "src1"))
    rows += [(95, None, "en", "src2"), (96, "", "fr", None), (97, "   \n\t", None, "src3"), (98, "one two", "en", "other"),
             (99, "One\x0btwo", "en", "other"), (100, "é😀 " * 30 + "\n" + "password: 'é😀", "fr", "src4"),
             (101, " ".join(rng.choice(vocabulary) for _ in range(20000)), "en", "src4"),
             (102, "12345 67890", "en", "src4"), (103, "a " * 500, "en", "src4")]
    schema = "doc_id long, text string, lang string, source string, n int, d int, key string, found int, kept_text int, rank int"
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5) for r in rows], schema).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
