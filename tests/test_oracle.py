"""Every registered query against its SQL twin on the same tables, and its plan."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from plan_text import plan_of

QUERIES = {name: query for name, query in entry.queries().items() if name in entry.QUERIES}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"create view {table.stem} as select * from '{table}'")
    return connection


# The queries with block distances or trees; all others stay in the JVM.
WITH_PYTHON = {
    "cluster_order_molecules", "cluster_order_samples", "cluster_merges_samples", "nearest_k_profiles", "nearest_k_profiles_processed",
    "nearest_profile", "nearest_profile_processed",
}

# SQL type names of the column types that results may have.
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    ours = as_rows(found.columns, [tuple(row) for row in found.collect()])
    cursor = duck.execute(SQL[name])
    names = [column[0] for column in cursor.description]
    theirs = as_rows(names, cursor.fetchall())
    assert sorted(names) == sorted(found.columns)
    kinds = {column[0]: str(column[1]) for column in cursor.description}
    assert {column: TYPES[kind] for column, kind in found.dtypes} == kinds
    assert len(ours) == len(theirs)
    assert ours == theirs


    check_plan(name, plan_of(found))


def check_plan(name, plan):
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert len(re.findall(r"FileScan parquet \[l_", plan)) <= 1
    if name not in WITH_PYTHON:
        assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    assert len(found.collect()) > 0
    check_plan(name, plan_of(found))
