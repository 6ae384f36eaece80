import pytest

from tocsin.llm.workers import prepare_workers


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    prepare_workers(spark)
