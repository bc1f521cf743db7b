"""Every registered query of the core against its SQL on the smallest tables."""

import pytest

from strandline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, same_rows, name):
    frame = registry.QUERIES[name](spark, sf)
    assert len(set(frame.columns)) == len(frame.columns)
    if name in registry.SQL:
        same_rows(frame, con, registry.SQL[name])
    else:
        frame.collect()


def test_sql_belongs_to_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
