"""Every query with SQL gives what its SQL gives, on the smallest tables."""

import datetime as dt
import decimal
import os

import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def connect(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    return con


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def same(df, duck, sql):
    columns = sorted(df.columns)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, sf, duck, name):
    same(registry.QUERIES[name](spark, sf), duck, registry.SQL[name])


def test_entry(spark, sf):
    df = entry.entry(spark)
    assert df.columns == ["id", "source", "lex_rank", "vec_rank", "rrf", "boosted"] and df.count() >= 0


def test_the_core_needs_no_subpackage():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent
    for f in (root / "lodestone").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"(?:from|import)\s+lodestone\.llm|\bllm\b", f.read_text()), f
