import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ba", "ko", "lu", "mi", "ne", "po", "ra", "su", "ti", "ve") for b in ("lan", "der", "sto", "rim", "", "kus", "pet", "nor", "gal", "fis")]


def prose(n, seed=0):
    """n words, reproducible and hardly ever the same run twice."""
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(x >> 33) % 100] + WORDS[(x >> 50) % 100])
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank, very short and very long texts, repeated rows and ids, columns with names used inside."""
    long_ = prose(30_000, 99)
    rows = [
        (1, prose(200, 1), "en", "a"), (2, prose(200, 1), "en", "a"), (3, prose(200, 1) + " end", None, None), (4, None, "en", "b"), (5, "", None, "b"),
        (6, " \n\t ", "de", None), (7, "one", "en", "c"), (7, "one", "en", "c"), (8, "One", "en", "c"), (None, prose(200, 1), "en", "a"),
        (None, None, None, None), (9, long_, "en", "a"), (10, long_, "en", "d"), (11, prose(300, 5), "fr", "d"), (11, prose(300, 6), "fr", "d"),
        (12, "日本語 のテキスト é " * 300, "ja", "e"), (13, "\U0001f600" * 700, None, "e"), (14, "12 34 %% --", "en", "e"),
        (15, prose(200, 1), "en", "a"), (15, prose(200, 1), "en", "a"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), "x", 0, "y", 1.5, "z", "w") for r in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, id string, key int, component string, score double, "
        "`bucket` string, `__id` string")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def con():
    connection = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection
