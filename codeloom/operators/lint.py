"""Lint rules over the local variables of functions (uses as of `extract.uses_of`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lookup import safe_regex

_KEY = ["rel_path", "from_id", "variable"]


def _kept(uses: DataFrame, ignore: str | None) -> DataFrame:
    """Without the variables that a valid ignore pattern fits; an invalid one ignores none."""
    return uses.filter(~F.col("variable").rlike(ignore)) if ignore and safe_regex(ignore) else uses


def _first(uses: DataFrame, use: str) -> DataFrame:
    """The first place of a use of each variable."""
    at = F.min(F.struct("line", "column_no"))
    return uses.filter(F.col("use") == use).groupBy(*_KEY).agg(at.alias("at")).select(*_KEY, "at.line", "at.column_no")


def implicit_locals(uses: DataFrame, ignore: str | None = None) -> DataFrame:
    """Variables that are written and never declared, at their first write."""
    uses = _kept(uses, ignore)
    declared = uses.filter(F.col("use").isin("param", "result", "var")).select(*_KEY).distinct()
    return _first(uses, "write").join(declared, _KEY, "left_anti")


def unused_locals(uses: DataFrame, ignore: str | None = None) -> DataFrame:
    """Variables that are written and never read, at their first write."""
    uses = _kept(uses, ignore)
    return _first(uses, "write").join(uses.filter("use = 'read'").select(*_KEY).distinct(), _KEY, "left_anti")


def unused_parameters(uses: DataFrame, ignore: str | None = "^_") -> DataFrame:
    """Parameters that are never read, where they are declared; results are no parameters."""
    uses = _kept(uses, ignore)
    return _first(uses, "param").join(uses.filter("use = 'read'").select(*_KEY).distinct(), _KEY, "left_anti")
