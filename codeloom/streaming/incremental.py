"""Incremental upkeep: change batches, their policy and the recomputation of what they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_path(changes: DataFrame) -> DataFrame:
    """Of each (batch_id, path) the last kind by event_seq."""
    return changes.groupBy("batch_id", "path").agg(F.max_by("kind", "event_seq").alias("kind"))


def must_rebuild(n_changed: Column, n_files: Column, n_other: Column) -> Column:
    """Whether a batch is built anew: a change that is no code, or more files than max(200, a fifth)."""
    return (n_other > 0) | (n_changed > F.greatest(F.lit(200), F.ceil(n_files * 0.2)))


def name_keys(hint_kind: Column, name: Column, class_name: Column) -> Column:
    """The lower-case names that a site's resolution depends on: its member and its class."""
    none = F.array().cast("array<string>")
    keys = F.filter(F.array(F.lower(name), F.lower(class_name)), lambda k: k.isNotNull())
    return F.when(hint_kind.isin("ExecuteMethodDynamic", "Formula"), none).otherwise(keys)


def affected_sites(sites: DataFrame, keys: DataFrame, changed: DataFrame) -> DataFrame:
    """Sites outside the changed files that name a symbol which came or went (keys: column key)."""
    rest = sites.join(changed.select("path"), "path", "left_anti")
    hit = rest.select("path", "site_no", F.explode("keys").alias("key")).join(keys.select("key").distinct(), "key", "left_semi").select("path", "site_no").distinct()
    return rest.join(hit, ["path", "site_no"])


def apply_batch(old: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by path after a batch: those of unchanged files and the new ones of changed files that still exist."""
    return old.join(changed.select("path"), "path", "left_anti").unionByName(new.join(changed.filter("kind != 'delete'").select("path"), "path", "left_semi"))


def run_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Feed a stream of (path, kind, event_seq) to `apply` in micro-batches, the last kind of a path only.

    Micro-batches run one after the other; `apply` gets the batch's number and may see a batch again
    after a failure, so it must be idempotent.
    """

    def each(batch: DataFrame, number: int) -> None:
        apply(last_per_path(batch.withColumn("batch_id", F.lit(number))).drop("batch_id"), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
