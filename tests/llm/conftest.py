from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def python_path(spark):
    import os

    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text[, lang[, source]])."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCS)

    return build


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """A folder with the given DataFrames as tables."""

    def build(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return build
