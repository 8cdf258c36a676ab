from __future__ import annotations

import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as documents: nulls, empty texts, repeated rows."""

    def make(texts: list[str | None], start: int = 0):
        rows = [(start + k, t, "en", f"src{k % 3}", len(t) if t else 0) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENT)

    return make


@pytest.fixture(scope="session")
def odd_documents(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "src0", 0), (None, "plain words without id", "en", None, 22),
        (3, "the same words twice", "en", "src0", 20), (3, "the same words twice", "en", "src0", 20),
        (4, "word " * 60_000, "en", "src1", 300_000), (5, "x" * 200_000, "en", "src1", 200_000), (6, " \t\n", None, "src2", 3),
    ]
    return spark.createDataFrame(rows, DOCUMENT)
