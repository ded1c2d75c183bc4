import pytest
from odd_rows import odd_rows

from newsdesk.llm.storage import ship_package

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, score string, keys string, label string, block int"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
