"""Every registered query of the subpackage against its SQL on the smallest tables."""

import pytest

from strandline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, con, same_rows, name):
    frame = queries.QUERIES[name](spark, sf)
    if name in queries.SQL:
        same_rows(frame, con, queries.SQL[name])
    else:
        frame.collect()
