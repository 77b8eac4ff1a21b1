import pytest
from compare import differences

from marlstone.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differences(queries.queries()[name](spark, FOLDER), queries.oracle_sql()[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(queries.whole_sql()))
def test_whole_query_equals_its_sql(spark, name):
    assert differences(queries.whole_queries()[name](spark, FOLDER), queries.whole_sql()[name], FOLDER) == ""


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 11)]
