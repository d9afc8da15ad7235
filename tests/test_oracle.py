import pytest
from oracle import differences

from cairn import plans


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, sf, name):
    assert not differences(spark, plans.queries()[name], plans.oracle_sql()[name], sf)
