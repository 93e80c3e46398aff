"""Every registered query against its SQL oracle, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_oracles as checker  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return checker.connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(entry.catalogue()) == set(entry.ORACLES)


@pytest.mark.parametrize("name", sorted(entry.catalogue()))
def test_query(spark, con, name):
    line = checker.check(spark, con, FOLDER, name)
    assert " ok " in line, line
