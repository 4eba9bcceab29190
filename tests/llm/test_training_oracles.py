import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from comparing import compared  # noqa: E402
from weftlight.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    ours, theirs = compared(spark, small, QUERIES[name], ORACLES[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    frame = QUERIES[name](spark, small)
    rows = frame.collect()
    assert frame.columns and rows
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows})
