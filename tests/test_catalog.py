import __spark_entry__ as contract
import oracle_check as oc
import pytest

from runledger.catalog.oracle import ORACLE
from runledger.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return oc.connect(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    columns, rows = oc.spark_rows(df)
    sql_columns, sql_rows = oc.sql_rows(con, ORACLE[name])
    assert columns == sql_columns
    assert oc.spark_types(df) == oc.sql_types(con, ORACLE[name])
    assert len(rows) == len(sql_rows)
    assert rows == sql_rows
    plan = df._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "Python" not in plan


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["branch", "host", "compiler"]


def test_parts_follow_the_size_of_the_rows(spark, small):
    from runledger.catalog import samples

    plan = samples.cells(spark, small)._jdf.queryExecution().toString()
    assert "RebalancePartitions" in plan and "REPARTITION_BY_NUM" not in plan


def test_logs_carry_further_columns_without_a_join(spark, small):
    from runledger.catalog import samples

    logs = samples.logs(spark, small, "mpi", "m_version")
    assert {"mpi", "m_version", "text", "path"} <= set(logs.columns)
    plan = QUERIES["lookup_missing_attribute"](spark, small)._jdf.queryExecution().toString()
    # Customers are joined once for records and once for logs, and outcomes once.
    assert plan.split("== Physical")[0].split("Optimized")[-1].count("Join ") == 3


def test_files_of_a_tree_are_dealt_to_many_tasks(spark, small, monkeypatch):
    from runledger.catalog import samples
    from runledger.session import file_tasks

    frame, seen = type(spark.range(1)), []
    old = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: seen.append(a[0]) or old(self, *a))
    samples.tree(spark, small)
    assert seen == [file_tasks(spark)] * 3
