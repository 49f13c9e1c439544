"""Every registered query against its SQL on the smallest given tables (the larger ones:
``python -m tests.oracle``)."""

import pytest

from draftlake.catalogue import load
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"
#: Queries that find nothing in so small tables (at sf0.01 they do).
EMPTY = {"one_to_one"}


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_query(spark, name):
    ok, note, _ = compare(spark, name, SMALL)
    assert ok or (note == "rows=0" and name in EMPTY), note
