import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def real(spark):
    """A few hundred documents of the given tables, enough copies and passages among them."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one very long text."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    same = " ".join(f"s{i}" for i in range(120))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, same), (6, same), (6, same), (7, same + " tail"), (8, long), (None, same), (None, None),
        (9, "Über straße № 5 <|endoftext|> 'tis x"), (10, "a b c d"), (11, "A B c d"),
    ]
    return [(k, t, None if i % 3 == 0 else "en", "s", None) for i, (k, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names clash with those of the operators."""
    extra = spark.createDataFrame(odd_rows, SCHEMA)
    for name in ("_key", "_text", "_row", "_mark", "n_words", "kept", "h", "shard", "slot", "label", "bucket"):
        from pyspark.sql import functions as F

        extra = extra.withColumn(name, F.lit("clash"))
    return extra


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], T.StructType.fromDDL(SCHEMA))
