"""Every registered query outside the corpus operators against its SQL twin."""

import compare
import pytest

from seekspark.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        assert compare.differences(df, catalogue.ORACLES[name], duck) is None
    else:
        assert df.columns and df.count() > 0


def test_oracles_have_queries():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
