import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from contactmill.session import local_session
    return local_session("tests", "4")


@pytest.fixture(scope="session")
def tables(spark):
    from contactmill.plans.derived import Tables
    return Tables(spark, SMALL)


@pytest.fixture
def one(spark):
    """Value of a column rule for one input row: one({"url": "..."}, lambda: rule("url"))."""
    def run(row: dict, rule):
        schema = ", ".join(f"`{k}` {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items())
        return spark.createDataFrame([tuple(row.values())], schema).select(rule().alias("r")).first()["r"]
    return run
