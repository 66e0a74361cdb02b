from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("QUILL_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import local_session

    return local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture
def corpus(spark):
    """(texts) -> documents numbered from 0."""
    return lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
