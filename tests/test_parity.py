"""Every registered query against its SQL twin, on the smallest tables."""
import pytest

import __spark_entry__ as driver
from parity import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_has_rows_and_every_oracle_a_query(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_matches_sql(spark, con, name):
    df = driver.queries()[name](spark, SF)
    rows = df.collect()
    if name not in driver.oracle_sql():
        assert rows
        return
    cursor = con.execute(driver.oracle_sql()[name])
    assert compare(rows, df.columns, cursor.fetchall(), [d[0] for d in cursor.description]) == []
