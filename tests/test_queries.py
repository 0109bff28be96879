"""Every registered query on the smallest tables, against its SQL twin."""

import pytest

from tessera import queries as registry
from tests.compare import connect, difference, from_spark, from_sql
from tests.conftest import SMALL

registry.load_all()


@pytest.fixture(scope="module")
def duck():
    with connect(SMALL) as con:
        yield con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    result = registry.QUERIES[name](spark, SMALL)
    rows = from_spark(result)
    if name in registry.SQL:
        assert difference(rows, from_sql(duck, registry.SQL[name])) is None
    else:
        assert rows[1]


def test_trained_indexes_find_most_neighbours(spark):
    assert registry.QUERIES["ivf_trained_recall"](spark, SMALL).first()["recall"] > 0.6
    assert registry.QUERIES["ivf_pq_trained_recall"](spark, SMALL).first()["recall"] > 0.35
