"""Each SQL report equals its DataFrame twin (names, types and values)."""

import pytest

from spendlens.plans import reports
from spendlens.plans.chain import build
from spendlens.plans.twins import TWINS
from tests.conftest import SF001


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin_equals_sql(spark, name):
    t = build(spark, SF001)
    sql = reports.run_query(spark, t.transactions, name)
    twin = TWINS[name](t.transactions)
    assert sql.columns == twin.columns
    assert [f.dataType.simpleString() for f in sql.schema] == [f.dataType.simpleString() for f in twin.schema]
    assert sorted(map(tuple, sql.collect()), key=repr) == sorted(map(tuple, twin.collect()), key=repr)
