import pytest
from compare import differences

from marlstone import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differences(catalogue.queries()[name](spark, FOLDER), catalogue.oracle_sql()[name], FOLDER) == ""


def test_flagship_has_rows(spark):
    assert catalogue.flagship(spark, FOLDER).count() == 10
