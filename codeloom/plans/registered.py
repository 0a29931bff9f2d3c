"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.index import Index
from codeloom.plans.projection import duck_prelude, model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Ancestors and members, for oracles of class queries.
CHAIN = """, up(class_lc, ancestor_lc, depth) AS (SELECT lower(name), lower(extends_class), 1 FROM symbols WHERE kind = 'Class' AND extends_class IS NOT NULL
UNION SELECT up.class_lc, lower(s.extends_class), depth + 1 FROM up JOIN symbols s ON s.kind = 'Class' AND s.name_lc = up.ancestor_lc WHERE s.extends_class IS NOT NULL),
funcs AS (SELECT lower(owner_class) AS owner_lc, name_lc, symbol_id, symbol_seq, kind FROM symbols WHERE kind IN ('ClassFunction', 'ClassGetter', 'ClassSetter'))"""


def query(name: str, sql: str | None = None, plain: bool = False):
    """Register f(model) -> DataFrame; sql follows the graph's common table expressions unless `plain`."""

    def put(f: Callable[[Index], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(model(spark, sf_dir))
        if sql:
            SQL[name] = sql if plain else f"{duck_prelude()}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return put
