"""Registered queries against their SQL, over the smallest tables."""

import collections
import glob
import itertools
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from quillgraph.operators import stats
from quillgraph.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) else v for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert set(got.columns) == set(want.columns)
    assert rows(got) == rows(want)


def test_all_but_the_simulation_have_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"a22_centralisation_against_random"}


def test_simulation(spark):
    """Expected centralisation by enumeration of all ways to draw the links of a group of three and of one of four."""
    pairs = {n: list(itertools.combinations(range(n), 2)) for n in (3, 4)}
    links = [("a", "b", 3), ("b", "c", 1), ("p", "q", 1), ("q", "r", 1), ("r", "s", 1)]
    groups = [(x, "one") for x in "abc"] + [(x, "two") for x in "pqrs"]
    found = {r.group_id: r for r in stats.centralisation_against_random(spark.createDataFrame(links, "a string, b string, weight long"), spark.createDataFrame(groups, "name string, group_id string")).collect()}
    for name, n, m, observed in (("one", 3, 4, 2), ("two", 4, 3, 2)):
        total = 0
        for drawn in itertools.product(pairs[n], repeat=m):
            degree = collections.Counter(x for p in drawn for x in p)
            total += n * max(degree.values()) - 2 * m
        want = total / len(pairs[n]) ** m
        r = found[name]
        assert r.n == n and r.observed == observed and abs(r.expected - want) < 0.02 * want and abs(r.ratio - r.observed / r.expected) < 1e-9


def test_the_registered_simulation(spark):
    rows = catalog.queries()["a22_centralisation_against_random"](spark, SF).collect()
    assert rows and all(r.n >= 1 and r.expected >= 0 for r in rows)


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["src", "dst", "spx"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_patent_table_makes_the_first_industries_only(spark, monkeypatch):
    asked, real = [], catalog.patents.industries
    monkeypatch.setattr(catalog.patents, "industries", lambda codes, table, first=None: (asked.append(first), real(codes, table, first))[1])
    catalog.queries()["a13_patent_table"](spark, SF)
    assert asked == [5]
