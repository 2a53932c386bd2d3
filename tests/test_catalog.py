"""Every registered query of the library runs, and equals its SQL where it has one."""

from __future__ import annotations

import inspect

import pytest
from oracle import DATA, connection, same

import __spark_entry__ as entry
from quarrion.plans import catalog, library


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, DATA), catalog.ORACLE[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert df.columns and rows
    assert all(any(v is not None for v in r) for r in rows)


def test_topic_model_runs_the_operators_rounds(spark, monkeypatch):
    seen, whole = [], library.T.nmf

    def nmf(*args, **options):
        own = inspect.signature(whole).bind(*args, **options)
        own.apply_defaults()
        seen.append(own.arguments["rounds"])
        return whole(*args, **options | {"rounds": 1})

    monkeypatch.setattr(library.T, "nmf", nmf)
    library.topic_model(spark, DATA)
    assert seen == [inspect.signature(whole).parameters["rounds"].default]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
