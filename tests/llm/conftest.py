import pytest

from conftest import SF01

#: Null, empty, blank, short, repeated and long texts; a null id; equal rows; a null source.
EDGE_DOCS = [
    (1, "The quick brown fox jumps over the lazy dog. It was not amused at all by this strange affair. " * 3, "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", "b", 4),
    (5, "one", "en", None, 3),
    (6, "same words here again for everyone to see", "en", "b", 1),
    (6, "same words here again for everyone to see", "en", "b", 1),
    (7, "same words here again for everyone to see", "de", "b", 1),
    (None, "a text without any id, yet it has words", "fr", "c", 2),
    (8, "word " * 5000, "en", "a", 25000),
    (9, "x" * 30000, "en", "a", 30000),
    (10, "Grüße 😀 aus Köln \x0b und\x0cmehr, mail a.b@c.de or +1 (269) 555-3296!", "de", "c", 60),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    """Columns named like those that operators make."""
    from pyspark.sql import functions as F
    made = ("size", "score", "kept", "target", "fp", "key", "spans", "shard", "root", "_row", "ids", "n_removed", "h")
    return edge.withColumns({c: F.lit(f"own {c}") for c in made})


@pytest.fixture(scope="session")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (99, 1, 1)],
                                 "doc_id long, quality int, toxic int")
