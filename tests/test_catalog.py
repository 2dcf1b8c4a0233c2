"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from pagelathe.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    run = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in run.fetchall()), key=repr)


#: Patterns that look around and stateful rules: held against brute force or fixtures in test_repair.py and test_waybills.py.
WITHOUT_SQL = {"nrm02_confusables", "nrm06_normalize_cyrillic", "nrm07_collapse", "pst06_russian", "pst07_english", "pst09_unify_scripts", "pst14_entities", "ext21_waybills_in_documents", "pst16_universal", "img06_clahe", "img04_gaussian", "img04_nonlocal_means"}


def test_every_other_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) | WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_runs(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
