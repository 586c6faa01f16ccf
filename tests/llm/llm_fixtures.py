import random

import pytest

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Builds a documents table of the given (doc_id, text) rows, with clashing extra columns."""
    def build(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, h string, n long")
    return build


@pytest.fixture(scope="session")
def table_rows():
    import duckdb

    def read(name, columns, sf=SF_SMALL):
        return duckdb.sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()
    return read


@pytest.fixture
def rng():
    return random.Random(7)
