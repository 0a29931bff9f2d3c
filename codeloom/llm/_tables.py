"""Intermediate tables, columns by their exact name, and columns that go through Python unread."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from codeloom.plans.tables import discard, shared_dir, stored

__all__ = ["Carried", "carry", "column", "discard", "shared_dir", "stored"]


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name; dots in names are not paths."""
    return df["`" + name.replace("`", "``") + "`"]


@dataclass
class Carried:
    """`rows` has the texts first, as strings, then the other columns to be kept under names of its own, which nothing clashes with."""

    rows: DataFrame
    names: list[str]
    places: list[int]  # the column of `rows` for each kept one; a kept text is not sent twice
    schema: str  # of the kept columns, as inner0, inner1, ... with a comma behind each

    def __getstate__(self) -> dict:
        return {"places": self.places}  # all that a worker needs

    def take(self, batch: pa.RecordBatch) -> list[pa.Array]:
        """The kept columns of a batch of `rows`."""
        return [batch.column(k) for k in self.places]

    def named(self, out: DataFrame, added: list[str]) -> DataFrame:
        """`out`, which has the kept columns and then some more, under the names for both."""
        return out.toDF(*self.names, *added)


def carry(df: DataFrame, text: str, keep: list[str] | None, added: list[str]) -> Carried:
    """The column `text` and the columns `keep` (all if None), save those that a column of `added` takes the place of."""
    names = [c for c in (keep if keep is not None else df.columns) if c not in added]
    places, columns = [], []
    for name in names:
        if name == text and df.schema[name].dataType.simpleString() == "string":
            places.append(0)
        else:
            columns.append(column(df, name).alias(f"inner{len(columns)}"))
            places.append(len(columns))
    rows = df.select(column(df, text).cast("string").alias("text"), *columns)
    schema = "".join(f"kept{k} {rows.schema[p].dataType.simpleString()}, " for k, p in enumerate(places))
    return Carried(rows, names, places, schema)
