import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns named like outputs."""
    rows = [(1, "The cat sat on the mat. " * 3, "x"), (2, None, "y"), (3, "", "z"), (4, "a", None), (5, "word " * 5000, "w"),
            (5, "word " * 5000, "w"), (None, "no id here, only words", "v"), (7, "İstanbul ﬁ \x1c é 🎉 <|endoftext|> don't", "u"),
            (8, "x" * 20000, "t"), (9, "a@b.co 10.0.0.1 and +1 (269) 555-3296 4524132264652876", "s")]
    names = ["score", "n_tokens", "ids", "spans", "hit_spans", "fingerprint", "signature"]
    return spark.createDataFrame([(*r, *["own"] * len(names)) for r in rows],
                                 "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def many(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    return f"file://{os.fspath(tmp_path_factory.mktemp('files'))}"
