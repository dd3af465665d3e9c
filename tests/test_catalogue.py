"""Every query of the catalogue against its SQL."""

import pytest

from compare import connect, rows
from conftest import SMALL

from sparrowtext import catalogue


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    if name not in catalogue.ORACLE:
        assert len(got)
        return
    want = duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
