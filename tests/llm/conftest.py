import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, words string, held_out boolean"


def documents(spark, rows):
    """Rows ``(doc_id, text[, lang])`` as a documents table with further columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 0.5, 7, "w", True) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and long texts, ties and repeated rows."""
    return docs_of([
        (1, None), (2, ""), (3, " \n\t "), (None, "some words here and there"), (None, None), (4, "a b c d e f"),
        (4, "a b c d e f"), (5, "word " * 20_000), (6, "x" * 50_000), (7, "ünïcödé ñandú 漢字 😀 text"), (8, None, None),
    ])


@pytest.fixture(scope="session")
def nothing(docs_of):
    return docs_of([])
