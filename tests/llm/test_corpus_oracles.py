import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import AVAILABLE, same  # noqa: E402

from graphloom.llm.queries import ORACLES, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not AVAILABLE, reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_one_query_for_each_operator():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 11)} | {"pipeline"}
