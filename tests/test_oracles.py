import pytest
from oracle import AVAILABLE, same

from graphloom.plans.oracles import ORACLES
from graphloom.plans.queries import QUERIES

pytestmark = pytest.mark.skipif(not AVAILABLE, reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["new_id", "old_id", "degree"]
