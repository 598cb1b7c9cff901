"""Every registered query against its SQL on the smallest tables, and house rules on the sources."""

import ast
import glob
import os

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_agrees_with_its_sql(spark, con, name):
    problem = oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert problem is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("path", sorted(glob.glob(f"{ROOT}/parity/**/*.py", recursive=True)))
def test_no_frame_goes_through_the_driver(path):
    """toPandas, RDDs and local checkpoints are not used; collect only where the result is bounded."""
    bounded = {"files.py", "groupby.py", "profile.py", "records.py"}
    for node in ast.walk(ast.parse(open(path).read())):
        if isinstance(node, ast.Attribute):
            assert node.attr not in {"toPandas", "rdd", "localCheckpoint", "foreachPartition"}, node.lineno
            if node.attr == "collect":
                assert os.path.basename(path) in bounded, node.lineno
