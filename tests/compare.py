"""Run a registered query and its DuckDB SQL over the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted(tuple(map(plain, x)) for x in zip(*[table[n].to_pylist() for n in names], strict=True)), names


def differences(spark, query, sql: str, sf_dir: str, columns: list[str] | None = None) -> list:
    """Up to five rows that only one side has, or [] if both agree."""
    df = query(spark, sf_dir)
    mine, names = rows_of((df.select(*columns) if columns else df).toArrow())
    theirs, other = rows_of(duck(sf_dir).sql(sql).to_arrow_table())
    if names != other:
        return [("columns", names, other)]
    if mine == theirs:
        return []
    a, b = set(mine), set(theirs)
    return [("rows", len(mine), len(theirs)), *[("spark", x) for x in sorted(a - b)[:3]], *[("duckdb", x) for x in sorted(b - a)[:3]]]
