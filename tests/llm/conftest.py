import pytest


@pytest.fixture(scope="module", autouse=True)
def scratch(spark):
    """Tables that a module's tests made go with it."""
    yield
    from chronoweave.llm import common

    common.drop(spark, *common.scratch_made())
    common.release(spark)
