"""Registered queries: archives, forms, folding and token layers."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import extract, tokens
from codeloom.plans.more_queries import _lined
from codeloom.plans.registered import query
from codeloom.plans.source_queries import _sources
from codeloom.sources import archives


def _zipped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for key, name in zip(frame["n_nationkey"], frame["n_name"], strict=True):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                z.writestr("notes.json", json.dumps({"methods": {"no_such": {}}}))
                z.writestr(archives.METHODS, json.dumps({"methods": {f"run_{key}": {}}}))
                z.writestr(archives.CLASSES, json.dumps({"Box": {"functions": {"open": {}}, "properties": {"lid": {"className": "Lid"}}, "constructorID": "x"}}))
            rows.append((name, int(key) % 2, buffer.getvalue() if key % 5 else b"broken"))
            rows.append((name, 2, b"broken"))
        yield pd.DataFrame(rows, columns=["component", "rank", "content"])


@query("src_11_components", "SELECT n_name AS component, unnest([concat('method..run_', n_nationkey), 'class..Box', 'constructor.Box.Box', 'function.Box.open', 'property.Box.lid']) AS what FROM nation WHERE n_nationkey % 5 <> 0", plain=True)
def src_11(m):
    rows = archives.components(m.table("nation").select("n_nationkey", "n_name").mapInPandas(_zipped, "component string, rank int, content binary"))
    return rows.select("component", F.concat_ws(".", "kind", F.coalesce("class", F.lit("")), "name").alias("what"))


@query("src_12_form_walk", "SELECT concat('f', p_partkey) AS rel_path, unnest(['BareName', 'VarGet']) AS hint_kind, unnest([concat('Do_', lower(p_type)), 'total']) AS name FROM part", plain=True)
def src_12(m):
    content = F.concat(F.lit('{"pages":[null,{"objects":{"b":{"type":"button","dataSource":"Do_'), F.lower("p_type"), F.lit('(1)","text":"No_call(1)"},"l":{"columns":[{"columnDataSource":"$x.total"}]}}}]}'))
    out = archives.form_sites(m.table("part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("rel_path"), content.alias("content")))
    return out.select("rel_path", "hint_kind", "name")


@query("qry_18_folding", "SELECT concat('Methods/m', p_partkey, '.4dm') AS rel_path, 6 AS start_line, 8 AS end_line FROM part", plain=True)
def qry_18(m):
    blocks = extract.blocks_table(_sources(m), "rel_path", "content")
    return blocks.select("rel_path", (F.col("start_line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"))


@query("qry_19_semantic_tokens", "SELECT p_partkey, CAST(14 AS BIGINT) AS n_kept FROM part", plain=True)
def qry_19(m):
    lex = tokens.tokens_table(_lined(m), "p_partkey", "content").filter(~F.col("kind").isin("operator", "identifier"))
    # symbol tokens cover the tables' names and win where they overlap
    own = lex.filter("kind = 'fieldRef'").select("p_partkey", "line", "start", F.lit(2).alias("length"), F.lit("symbol").alias("kind"))
    a, b = lex.alias("a"), own.alias("b")
    free = a.join(b, (F.col("a.p_partkey") == F.col("b.p_partkey")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.start") < F.col("b.start") + F.col("b.length")) & (F.col("b.start") < F.col("a.start") + F.col("a.length")), "left_anti")
    rows = free.select("p_partkey", "line", "start", "length", "kind").union(own)
    w = Window.partitionBy("p_partkey").orderBy("line", "start")
    span = F.struct("line", "start", "length")
    kept = rows.select("p_partkey", span.alias("s"), F.lag(span).over(w).alias("p")).filter("p is null or p != s")
    return kept.groupBy("p_partkey").agg(F.count("*").alias("n_kept"))
