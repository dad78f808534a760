"""Every registered query against its comparison SQL on the smallest data; rows-only queries must run."""

import glob

import pytest

from airlens.plans import catalog  # noqa: F401
from airlens.plans.registry import ORACLES, QUERIES
from tests_compare import DATA, compare, duck

FOLDER = f"{DATA}/sf0.001"
HEAVY = {"rewrite_tables", "decode_frames"}  # checked by tests/compare.py at sf0.01


@pytest.fixture(scope="module")
def con():
    if not glob.glob(f"{FOLDER}/events.parquet"):
        pytest.skip("no test data")
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in HEAVY])
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == []
    else:
        assert df.columns and df.count() >= 0
