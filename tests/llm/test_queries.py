import pytest
from compare import duck, same_rows

from sparrel.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_against_sql(spark, con, name):
    same_rows(QUERIES[name](spark, FOLDER), con, ORACLE_SQL[name])
