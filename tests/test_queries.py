"""Every query against its SQL over the smallest tables."""

import pytest

from plumbline.plans import catalog

from .oracle import check

SMALL = "/root/testdata/sf0.001"
#: finds nothing in the one report of the smallest tables, so it is compared over the next larger ones
SPARSE = {"eva_04_extra"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    where = SMALL.replace("0.001", "0.01") if name in SPARSE else SMALL
    df = catalog.QUERIES[name](spark, where)
    assert check(df, catalog.ORACLES[name], where) if name in catalog.ORACLES else df.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
