import pytest


@pytest.fixture(scope="session")
def documents():
    import duckdb
    return duckdb.sql("SELECT * FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").df()


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with extra columns whose names the operators use inside."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, "x", 7, 0.5) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "whole_row string, size int, score double")
    return build
