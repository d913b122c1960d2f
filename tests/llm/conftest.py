import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text) or longer rows."""

    def make(rows, schema=DOCS):
        width = len(schema.split(", "))
        return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)

    return make
