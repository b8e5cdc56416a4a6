"""Every registered query beside its oracle, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows_and_names(spark):
    page = entry(spark)
    rows = page.collect()
    assert len(rows) == 20 and page.columns[:3] == ["platform", "source_id", "title"]
    assert rows == sorted(rows, key=lambda r: (r.platform, r.source_id))
    assert set(ORACLES) <= set(QUERIES)
