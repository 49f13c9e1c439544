"""Every query of the subpackage on the smallest tables: against its SQL, or with rows at least."""

import pytest

from draftlake.llm.queries import load
from tests.llm.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_query(spark, name):
    ok, note, _ = compare(spark, name, SMALL)
    assert ok, note


def test_one_query_per_operator_and_the_pipeline():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names
