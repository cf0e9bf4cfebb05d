import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (3, "Le renard brun saute par-dessus le chien paresseux près de la rivière.", "fr", "b"),
    (3, "Le renard brun saute par-dessus le chien paresseux près de la rivière.", "fr", "b"),
    (4, "", "en", "a"),
    (5, None, None, None),
    (None, "a row without an id", "en", None),
    (6, " \n\t ", "fr", "b"),
    (7, "short", "en", "c"),
    (8, "12345 67 !!", "en", "c"),
    (9, "long " * 30_000 + "end", "en", "c"),
    (10, "Der schnelle braune Fuchs springt über den faulen Hund am Fluss.\n\nZweite  Zeile\n", None, "d"),
    (11, "emoji 😀 and  double  blanks\r\nand\ttabs　wide <|endoftext|> done", "en", "d"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, lang, source, len(t or ""), "x", 1, "h", 0) for i, t, lang, source in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size long, fp string, n int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
