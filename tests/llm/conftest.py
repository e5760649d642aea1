import pytest
from pyspark.sql import functions as F

from graphloom.llm.queries import ship_package

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def session(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def odd(session):
    """Documents with every awkward case, and columns named like those that operators make."""
    prose = " ".join(f"word{k} and thing{k % 7}" for k in range(80))
    rows = [(1, prose), (2, prose), (3, None), (4, ""), (5, " \n\t "), (6, prose.replace("word3 ", "other ")), (7, "short text"),
            (7, "short text"), (None, prose), (None, None), (8, "one\n\ntwo  three\t~ four <|endoftext|> é́ Σİ don't 12,5."),
            (9, "line again\nline again\n" * 40), (10, "x" * 70_000), (11, " ".join(f"long{k}" for k in range(30_000))), (12, "short text")]
    df = session.createDataFrame(rows, "doc_id long, text string")
    names = ("key", "node", "row", "shard", "slot", "score", "size", "ids", "u", "v", "label", "part", "words", "gram", "kind", "predicted", "signature")
    return df.select("*", *[F.lit(7).alias(n) for n in names]).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id = -1")
