"""Every registered query against its SQL on the whole tables."""

import pytest
from oracle import compare

from packetlake.queries import load

REGISTRY = load()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, sf_dir, name):
    function, sql = REGISTRY[name]
    if sql is None:
        assert function(spark, sf_dir).columns
    else:
        compare(spark, sf_dir, function, sql)
