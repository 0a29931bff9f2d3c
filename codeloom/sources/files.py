"""Project files as a DataFrame, and what their paths say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, root: str, exclusions: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """(rel_path, content, mtime) of all files under root; directories named in `exclusions` are left out."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    path = F.try_url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/"))
    rows = reader.load(root).select(path.alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("mtime"))
    rows = rows.withColumn("rel_path", F.expr(f"substring(path, {len(root.rstrip('/')) + 2})"))
    return rows.filter(~excluded(F.col("rel_path"), exclusions or []))


def excluded(rel_path: Column, exclusions: list[str]) -> Column:
    """Whether a directory of the path has an excluded name."""
    if not exclusions:
        return F.lit(False)
    parts = F.split(rel_path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(exclusions))


def classify(rel_path: Column) -> Column:
    """struct(category, container, owner_table_id) of a path below the project root; null if it is no source.

    Methods, classes, database methods, form and table-form methods, object methods and definitions
    are told by the shape of the path under Project/Sources.
    """
    p = F.split(rel_path, "/")
    n, kind = F.size(p), F.element_at(p, 3)
    last = F.element_at(p, -1)
    code = last.endswith(".4dm")
    base = F.regexp_replace(last, r"\.4dm$", "")
    under = (F.element_at(p, 1) == "Project") & (F.try_element_at(p, F.lit(2)) == "Sources")

    def row(category, container=None, table=None):
        none = F.lit(None).cast("string")
        return F.struct(F.lit(category).alias("category") if isinstance(category, str) else category.alias("category"), (container if container is not None else none).alias("container"), (table if table is not None else none).alias("owner_table_id"))

    form, table, table_form = F.try_element_at(p, F.lit(4)), F.try_element_at(p, F.lit(4)), F.try_element_at(p, F.lit(5))
    kind = F.try_element_at(p, F.lit(3))
    objects = F.try_element_at(p, F.lit(5)) == "ObjectMethods"
    table_objects = F.try_element_at(p, F.lit(6)) == "ObjectMethods"
    return (
        F.when(~under | (n < 4), None)
        .when((kind == "Methods") & code, row(F.when(base.startswith("Compiler_"), "compilerMethod").otherwise("method")))
        .when((kind == "Classes") & code, row("class", base))
        .when((kind == "DatabaseMethods") & code, row("databaseMethod"))
        .when((kind == "Forms") & (n == 5) & (last == "method.4dm"), row("formMethod", form))
        .when((kind == "Forms") & (n == 5) & (last == "form.4DForm"), row("formDefinition", form))
        .when((kind == "Forms") & objects & code, row("formObjectMethod", form))
        .when((kind == "TableForms") & (n == 6) & (last == "method.4dm"), row("tableFormMethod", table_form, table))
        .when((kind == "TableForms") & (n == 6) & (last == "form.4DForm"), row("tableFormDefinition", table_form, table))
        .when((kind == "TableForms") & table_objects & code, row("tableObjectMethod", table_form, table))
    )


def classify_change(rel_path: Column) -> Column:
    """code, catalog, constants, components or unknown: what a change of the path touches."""
    p = F.split(rel_path, "/")
    source = (F.element_at(p, 1) == "Project") & (F.try_element_at(p, F.lit(2)) == "Sources")
    return (
        F.when(source & rel_path.endswith(".4dm"), "code")
        .when(source & (F.size(p) == 3) & rel_path.endswith("/catalog.4DCatalog"), "catalog")
        .when((F.element_at(p, 1) == "Resources") & (F.size(p) == 2) & F.element_at(p, -1).rlike(r"(?i)^Constants_.*\.xlf$"), "constants")
        .when((F.element_at(p, 1) == "Components") & rel_path.rlike(r"(?i)\.4dz$"), "components")
        .otherwise("unknown")
    )


def table_names(files: DataFrame) -> DataFrame:
    """Catalog tables: names of the JSON files of the Tables folder."""
    return files.filter(F.col("rel_path").rlike(r"Catalog/Tables/[^/]+\.json$")).select(F.regexp_extract("rel_path", r"([^/]+)\.json$", 1).alias("name")).distinct()


def table_ids(files: DataFrame) -> DataFrame:
    """(id, name) of catalog tables; the file's name stands in for a missing one, malformed JSON is passed over."""
    rows = files.filter(F.col("rel_path").rlike(r"Catalog/Tables/[^/]+\.json$"))
    value = F.try_parse_json("content")
    base = F.regexp_extract("rel_path", r"([^/]+)\.json$", 1)
    out = rows.select(F.try_variant_get(value, "$['@id']", "string").alias("id"), F.coalesce(F.try_variant_get(value, "$['@name']", "string"), base).alias("name"))
    return out.filter("id is not null")


_COMMAND = "struct<name:string,commandName:string,syntax:string>"


def plugin_commands(files: DataFrame) -> DataFrame:
    """(plugin, command): of each bundle the manifest of lowest location rank that lists any command."""
    rows = files.filter(F.col("rel_path").rlike(r"Plugins/[^/]+\.bundle/.*manifest\.json$"))
    plain = F.from_json(F.regexp_replace("content", "^﻿", ""), f"struct<commands:array<{_COMMAND}>,themes:array<struct<commands:array<{_COMMAND}>>>>")
    rows = rows.select(F.regexp_extract("rel_path", r"Plugins/([^/]+)\.bundle", 1).alias("plugin"), F.length("rel_path").alias("rank"), plain.alias("m"))
    none = F.array().cast(f"array<{_COMMAND}>")
    nested = F.flatten(F.transform(F.coalesce("m.themes", F.array().cast(f"array<struct<commands:array<{_COMMAND}>>>")), lambda t: F.coalesce(t["commands"], none)))
    rows = rows.select("plugin", "rank", F.explode(F.concat(F.coalesce("m.commands", none), nested)).alias("c"))
    name = F.coalesce("c.name", "c.commandName", F.trim(F.split("c.syntax", r"\(")[0]))
    rows = rows.select("plugin", "rank", name.alias("command")).filter("command is not null and command != ''")
    first = rows.groupBy("plugin").agg(F.min("rank").alias("rank"))
    return rows.join(first, ["plugin", "rank"]).select("plugin", "command").distinct()


def constants(spark: SparkSession, path: str) -> DataFrame:
    """(name, value, type_letter, theme) of XLIFF constant files: groups name themes, values end in a type letter."""
    rows = spark.read.format("xml").option("rowTag", "group").option("attributePrefix", "_").load(path)
    units = rows.select(F.col("`_d4:groupName`").alias("theme"), F.explode(F.array("trans-unit") if not rows.schema["trans-unit"].dataType.typeName() == "array" else F.col("trans-unit")).alias("u"))
    name = F.coalesce(*[F.col(f"u.{c}") for c in ("_resname", "_id") if c in units.schema["u"].dataType.names])
    value = F.col("u.`_d4:value`").cast("string")
    return units.select(name.alias("name"), F.regexp_replace(value, r":[A-Z]$", "").alias("value"), F.regexp_extract(value, r":([A-Z])$", 1).alias("type_letter"), "theme")


def stale(cached: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, why) of files in which two listings (path, mtime in ms) differ: `added`, `removed` or `changed`, by more than a millisecond."""
    both = cached.select("path", F.col("mtime").alias("a")).join(listed.select("path", F.col("mtime").alias("b")), "path", "full")
    why = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.abs(F.col("a") - F.col("b")) > 1, "changed")
    return both.select("path", why.alias("why")).filter("why is not null")


def fresh(cached: DataFrame, listed: DataFrame) -> bool:
    """Whether two listings agree: the same files, times within a millisecond."""
    return stale(cached, listed).isEmpty()
