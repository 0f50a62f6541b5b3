"""Every query with SQL gives the same rows in both engines."""

import pytest
from support import DATA, same

from glyphlake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, f"{DATA}/sf0.001"), duck.sql(catalogue.ORACLE[name]))


def test_every_query_has_sql_or_a_reason():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"report_json", "report_text"}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
