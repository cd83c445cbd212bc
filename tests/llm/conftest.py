import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame(rows, DOCS)
