"""Every query with an oracle agrees with it, row for row."""

from __future__ import annotations

import pytest

from foliary.plans import catalogue
from tests.conftest import SF, plain

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(rows, got.columns) == plain(want.fetchall(), want.columns)


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_does_not_need_the_subpackage():
    """Nothing outside the subpackage and the pipeline names it."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for path in root.glob("foliary/**/*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "foliary.llm" not in path.read_text(), path
