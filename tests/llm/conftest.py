import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="session")
def docs_001(spark):
    """Documents of the smallest scale, as rows."""
    return sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns with clashing names."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "word " * 30_000, "b"), (5, "word " * 30_000, "b"), (None, "no id here", "c"),
            (6, "same text in two rows", "a"), (7, "same text in two rows", "a"), (8, "ünï çödé 日本 😀\n\n--\nline", None)]
    return spark.createDataFrame([(*r, 1, 2, "x", 3.0) for r in rows], "doc_id bigint, text string, source string, size int, fp int, line string, score double")
