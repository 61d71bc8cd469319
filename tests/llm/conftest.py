import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

ODD = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 3), (4, "word", "en", "b", 4), (4, "word", "en", "b", 4), (5, "word", "de", None, 4), (6, "Ünïcode \U0001f600 text " * 30, "fr", "b", 1), (7, "x " * 20000 + "end", "en", "a", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty texts, repeated rows, ties, a long text, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("t", "h", "id", "n", "w", "size", "kept", "keep_id", "component", "route", "key", "row_key", "r", "score")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, None), (5, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
