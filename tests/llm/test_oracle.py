import pytest

from scripts.check import compare
from tablecraft.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    status, _, _, note = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR)
    assert status == "ok", note


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
