import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import DOCS, strange  # noqa: E402


@pytest.fixture(scope="module")
def rng():
    return random.Random(5)


@pytest.fixture(scope="module")
def odd(spark, rng):
    """The strange rows, with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(strange(rng), DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("h", "host", "d", "th", "pos", "fp", "component_id", "score", "o1", "c", "kept", "n_words", "start", "mh", "first", "code")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)
