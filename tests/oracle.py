"""Rows of a query and of its SQL on DuckDB, made comparable."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def of_sql(sql, sf_dir, columns):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    found = [x[0] for x in con.execute(f"describe {sql}").fetchall()]
    assert sorted(found) == sorted(columns)
    names = ", ".join(f'"{c}"' for c in columns)
    return ordered(con.execute(f"select {names} from ({sql}) q").fetchall())


def of_spark(df, columns):
    return ordered(df.select(*[f"`{c}`" for c in columns]).collect())
