"""Queries of this folder against their SQL, and all of them once over the small tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check_oracles as checker  # noqa: E402

from tidemark.llm.oracles import ORACLES  # noqa: E402
from tidemark.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert " ok " in checker.check(spark, checker.connect(FOLDER), FOLDER, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
