import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from ``(doc_id, text)`` with extra columns, some with names the operators use inside."""

    def make(rows, parts=3):
        full = [(i, t, "en", "s", len(t) if t is not None else None, 7, 8) for i, t in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, tokens int, k1 int"
        return spark.createDataFrame(full, schema).repartition(parts)

    return make


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
