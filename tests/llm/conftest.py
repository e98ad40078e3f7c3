import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent)]

from hindcast.llm.queries import vocabulary  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, doc_id_ string, text_hash string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text[, lang, source]) rows, with extra columns whose names clash with the operators' own."""

    def make(rows, parts=2):
        full = [(*r, *(None,) * (4 - len(r)), None, "x", "y") for r in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def byte_bpe():
    pytest.importorskip("public_tokenizers")
    return vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def piece_bpe():
    pytest.importorskip("public_tokenizers")
    return vocabulary("piece_bpe_32k.model")
