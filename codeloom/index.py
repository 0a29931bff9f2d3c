"""The code graph: two DataFrames and the tables they come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class Index:
    """`symbols` and `edges` of a project.

    Row order is carried by symbol_seq and edge_seq: the lower one wins where the first wins.
    Positions are 0-based, line -1 is unknown.
    """

    symbols: DataFrame
    edges: DataFrame
    table: Callable[[str], DataFrame] | None = None

    @property
    def spark(self):
        return self.symbols.sparkSession
