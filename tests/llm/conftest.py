import pytest

from quire.llm import pii


@pytest.fixture(scope="session", autouse=True)
def surrogate_key(spark):
    spark.conf.set(pii.KEY_SETTING, "surrogate-key-1")
