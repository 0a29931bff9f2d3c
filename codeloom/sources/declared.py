"""Declarations, compiler types and test results read out of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines_of(files: DataFrame) -> DataFrame:
    """(rel_path, line, text) of files (rel_path, content)."""
    return files.select("rel_path", F.posexplode(F.split("content", r"\r?\n")).alias("line", "text"))


def variables(files: DataFrame) -> DataFrame:
    """(scope, name, type, rel_path, line) of process and interprocess variables.

    Declared as C_TYPE(names), `var names : Type` or ARRAY TYPE(name), or set where they are
    interprocess; of one scope and name compiler files come first, then path and line.
    """
    # lines with $ arguments type a method's parameters
    rows = lines_of(files).filter(~F.contains("text", F.lit("$")))
    legacy = F.regexp_extract("text", r"(?i)^\s*(?:C_|ARRAY\s+)(\w+)\s*\(([^)]*)\)", 2)
    modern = F.regexp_extract("text", r"(?i)^\s*var\s+([^:]+?)\s*(?::|$)", 1)
    kind = F.coalesce(F.nullif(F.regexp_extract("text", r"(?i)^\s*(?:C_|ARRAY\s+)(\w+)\s*\(", 1), F.lit("")), F.nullif(F.trim(F.regexp_extract("text", r"(?i)^\s*var\s+[^:]+:\s*(\S+)", 1)), F.lit("")))
    set_ = F.regexp_extract("text", r"^\s*(<>\w+)\s*:=", 1)
    names = F.coalesce(F.nullif(legacy, F.lit("")), F.nullif(modern, F.lit("")), F.nullif(set_, F.lit("")))
    found = rows.select("rel_path", "line", kind.alias("type"), F.explode(F.split(names, r"[;,]")).alias("name")).withColumn("name", F.trim("name"))
    found = found.filter(F.col("name").rlike(r"^(<>)?[A-Za-z_]\w*$")).withColumn("scope", F.when(F.col("name").startswith("<>"), "interprocess").otherwise("process")).withColumn("name", F.regexp_replace("name", "^<>", ""))
    first = Window.partitionBy("scope", F.lower("name")).orderBy(F.col("rel_path").rlike(r"/Compiler_[^/]*$").desc(), "rel_path", "line")
    return found.withColumn("r", F.row_number().over(first)).filter("r = 1").select("scope", "name", "type", "rel_path", "line")


def compiler_types(files: DataFrame) -> DataFrame:
    """(method, return_type, params map, variadic_from, variadic_type) from C_TYPE(Method; $n) lines: $0 is the return, ${n} the variadic tail."""
    pattern = r"(?i)^\s*C_(\w+)\s*\(\s*(\w+)\s*;\s*(.*)\)"
    rows = lines_of(files).filter(F.col("text").rlike(pattern)).select("rel_path", "line", F.regexp_extract("text", pattern, 1).alias("type"), F.regexp_extract("text", pattern, 2).alias("method"), F.explode(F.split(F.regexp_extract("text", pattern, 3), ";")).alias("arg"))
    number = F.regexp_extract("arg", r"(\d+)", 1)
    rows = rows.filter(number != "").withColumn("n", number.cast("int")).withColumn("tail", F.contains("arg", F.lit("{")))
    seq = F.struct("rel_path", "line")
    per = rows.groupBy("method", "n", "tail").agg(F.min_by("type", seq).alias("type"))
    return per.groupBy("method").agg(
        F.max(F.when((F.col("n") == 0) & ~F.col("tail"), F.col("type"))).alias("return_type"),
        F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when((F.col("n") > 0) & ~F.col("tail"), F.struct("n", "type"))), lambda x: x.isNotNull()))).alias("params"),
        F.min(F.when(F.col("tail"), F.col("n"))).alias("variadic_from"),
        F.min_by("type", F.when(F.col("tail"), F.col("n"))).alias("variadic_type"),
    )


RESULT = "struct<suite:string,tests:array<struct<name:string,passed:boolean,skipped:boolean,duration:double,assertions:array<struct<passed:boolean,message:string>>,runtimeErrors:array<struct<message:string>>>>>"


def test_results(files: DataFrame) -> DataFrame:
    """(suite, name, status, message, duration) of result JSON: skipped, then errored, then passed, else failed.

    A byte-order mark is dropped; content that doesn't parse is read again without control characters.
    """
    plain = F.regexp_replace("content", "^﻿", "")
    value = F.coalesce(F.from_json(plain, RESULT), F.from_json(F.regexp_replace(plain, r"[\x00-\x1f]", " "), RESULT))
    rows = files.select(value.alias("v")).select("v.suite", F.explode("v.tests").alias("t"))
    failed = F.try_element_at(F.filter(F.coalesce("t.assertions", F.array().cast("array<struct<passed:boolean,message:string>>")), lambda a: ~a["passed"]), F.lit(1))
    status = F.when(F.col("t.skipped"), "skipped").when(F.size(F.coalesce("t.runtimeErrors", F.array().cast("array<struct<message:string>>"))) > 0, "errored").when(F.col("t.passed"), "passed").otherwise("failed")
    return rows.select("suite", F.col("t.name").alias("name"), status.alias("status"), failed["message"].alias("message"), F.col("t.duration").alias("duration"))
