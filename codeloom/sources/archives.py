"""Component archives and form definitions."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.extract import sites_of_line
from codeloom.functions.text import scan_line

# Keys of form objects whose strings are expressions.
EXPRESSION_KEYS = {"dataSource", "expression", "variableCalculation", "columnDataSource", "methodName"}


# The members of a component archive that are read.
METHODS = "Project/DerivedData/methodAttributes.json"
SETTINGS = "Project/Sources/settings.4DSettings"
CLASSES = "Project/DerivedData/CompiledCode/classes.json"
# Fixed value: the attribute of the settings that names a component's class store.
NAMESPACE = r'component_classStore_name\s*=\s*"([^"]+)"'
#: A member that unpacks to more is passed over.
MAX_MEMBER = 64 << 20


def _members(content: bytes) -> dict[str, str]:
    """The texts of the three members; none of a corrupt archive."""
    out = {}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in (METHODS, SETTINGS, CLASSES):
                if name in z.NameToInfo and z.getinfo(name).file_size <= MAX_MEMBER:
                    out[name] = z.read(name).decode("utf-8-sig", "replace")
    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError, NotImplementedError):
        return {}
    return out


def archive_rows(content: bytes) -> Iterator[tuple[str, str | None, str, str | None]]:
    """(kind, class, name, type) of an archive's metadata: methods by name, the namespace of its
    settings, and classes with functions and typed properties; a corrupt archive or member has none."""
    texts = _members(content)
    if m := re.search(NAMESPACE, texts.get(SETTINGS, "")):
        yield "namespace", None, m[1], None

    def table(name: str) -> dict:
        try:
            value = json.loads(texts.get(name, ""))
        except ValueError:
            return {}
        return value if isinstance(value, dict) else {}

    methods = table(METHODS).get("methods")
    yield from (("method", None, name, None) for name in (methods if isinstance(methods, dict) else {}))
    for cls, body in table(CLASSES).items():
        if isinstance(body, dict) and ("functions" in body or "properties" in body or "constructorID" in body):
            yield "class", None, cls, None
            if body.get("constructorID"):
                yield "constructor", cls, cls, None
            yield from (("function", cls, f, None) for f in body.get("functions") or {})
            for p, kind in (body.get("properties") or {}).items():
                yield "property", cls, p, (kind or {}).get("className") if isinstance(kind, dict) else None


def components(archives: DataFrame) -> DataFrame:
    """(component, kind, class, name, type) of archives (component, rank, content); of equal names the lowest rank counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(c, r, *x) for c, r, b in zip(frame["component"], frame["rank"], frame["content"], strict=True) for x in archive_rows(bytes(b or b""))]
            yield pd.DataFrame(rows, columns=["component", "rank", "kind", "class", "name", "type"])

    own = archives.select("component", F.col("rank").cast("int").alias("rank"), "content")
    first = Window.partitionBy("component").orderBy("rank")
    kept = own.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
    return kept.mapInPandas(run, "component string, rank int, kind string, class string, name string, type string").drop("rank")


def form_expressions(text: str) -> Iterator[tuple[str, str]]:
    """(key, expression) of every string under an expression key, however deep."""
    try:
        stack = [json.loads(text)]
    except ValueError:
        return
    while stack:
        value = stack.pop()
        if isinstance(value, list):
            stack += value
        elif isinstance(value, dict):
            for key, x in value.items():
                if key in EXPRESSION_KEYS and isinstance(x, str) and x.strip():
                    yield key, x
                else:
                    stack.append(x)


def form_sites(forms: DataFrame) -> DataFrame:
    """Call sites, at line 0, of the expressions of form definitions (rel_path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["rel_path"], frame["content"], strict=True):
                for key, expression in form_expressions(text or ""):
                    rows += [(path, 0, key, s["hint_kind"], s.get("name")) for s in sites_of_line(scan_line(expression), set(), set())]
            yield pd.DataFrame(rows, columns=["rel_path", "line", "key", "hint_kind", "name"])

    return forms.select("rel_path", "content").mapInPandas(run, "rel_path string, line int, key string, hint_kind string, name string")


def xliff_units(text: str) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, value, type letter, theme) of the units of a constants file; groups name themes, values end in a type letter."""
    try:
        root = ElementTree.fromstring(text.lstrip("\ufeff"))
    except ElementTree.ParseError:
        return

    def own(node, key: str) -> str | None:
        return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == key), None)

    stack = [(root, None)]
    while stack:
        node, theme = stack.pop()
        if node.tag.rpartition("}")[2] == "trans-unit":
            value = own(node, "value")
            name = own(node, "resname") or next((c.text for c in node if c.tag.rpartition("}")[2] == "source"), None) or own(node, "id")
            if value is not None and name:
                m = re.fullmatch(r"(.*):([A-Z])", value, re.S)
                yield name.strip(), m[1] if m else value, m[2] if m else "", theme
        theme = own(node, "groupName") or theme
        stack += [(c, theme) for c in reversed(node)]


def xliff_constants(sources: DataFrame) -> DataFrame:
    """(name, value, type_letter, theme) of constants files (content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([x for text in frame["content"] for x in xliff_units(text or "")], columns=["name", "value", "type_letter", "theme"])

    return sources.select("content").mapInPandas(run, "name string, value string, type_letter string, theme string")
