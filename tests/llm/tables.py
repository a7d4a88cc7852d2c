"""Small documents tables for the tests here."""

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, extra=""):
        """Rows are (doc_id, text) or longer; the rest of the columns is filled up."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0",
                 None if r[1] is None else len(r[1])) + tuple(r[4:]) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS + extra)
    return make
