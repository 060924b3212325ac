"""Results do not depend on the number of shuffle partitions (every query)."""

import pytest

from railyard.plans import QUERIES
from conftest import SF_SMOKE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_partition_count_independent(spark, name):
    res = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            res.append(sorted(map(repr, QUERIES[name](spark, SF_SMOKE).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]
