import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, row string, class long, label string, regions int"


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text) pairs, with more columns whose names clash with results."""

    def make(*rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2, "y", 3) for i, t in rows], DOCS)

    return make
