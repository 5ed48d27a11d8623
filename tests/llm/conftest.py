import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs or (doc_id, text, lang, source) rows."""
    def make(*rows):
        full = [(*row, *(None, None, None, None)[len(row) :])[:4] for row in rows]
        return spark.createDataFrame([(*row, None if row[1] is None else len(row[1])) for row in full], DOCS)

    return make


@pytest.fixture(scope="session")
def sf_copy(spark, tmp_path_factory):
    """Writes tables as a data folder and returns its path."""
    def write(**tables):
        folder = str(tmp_path_factory.mktemp("sf"))
        for name, frame in tables.items():
            frame.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write
