"""Scalar text functions of the analyser as Columns; stateful scans as Arrow-batched UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

# Local type names that are folded to one spelling.
PRIMITIVES = {"text": "Text", "string": "Text", "alpha": "Text", "longint": "Integer", "integer": "Integer", "int": "Integer", "long": "Integer", "real": "Real", "number": "Real", "boolean": "Boolean", "bool": "Boolean", "date": "Date", "time": "Time", "object": "Object", "collection": "Collection", "variant": "Variant", "picture": "Picture", "pointer": "Pointer", "blob": "Blob"}

#: Words of C_<word> declarations and the types that they give.
C_TYPES = {"text": "Text", "string": "Text", "alpha": "Text", "longint": "Integer", "integer": "Integer", "real": "Real", "boolean": "Boolean", "date": "Date", "time": "Time", "object": "Object", "collection": "Collection", "picture": "Picture", "blob": "Blob", "pointer": "Pointer", "variant": "Variant"}


def scan_line(line: str) -> tuple[str, list[str], list[int]]:
    """A line without comments, its string literals replaced by their ordinal in quotes; the literals;
    and for every output place (and the end) the input place."""
    out: list[str] = []
    cols: list[int] = []
    strings: list[str] = []
    i, n = 0, len(line)
    while i < n:
        c = line[i]
        if c == '"':
            j, text = i + 1, []
            while j < n:
                if line[j] == '"':
                    if line[j + 1 : j + 2] != '"':
                        break
                    j += 1
                text.append(line[j])
                j += 1
            for ch in f'"{len(strings)}"':
                out.append(ch)
                cols.append(i)
            strings.append("".join(text))
            i = j + 1
        elif c == "`" or line.startswith("//", i):
            break
        elif line.startswith("/*", i):
            end = line.find("*/", i + 2)
            if end < 0:
                break
            i = end + 2
        else:
            out.append(c)
            cols.append(i)
            i += 1
    return "".join(out), strings, [*cols, min(i, n)]


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("strings", ArrayType(StringType())), StructField("cols", ArrayType(IntegerType()))]))
def clean_line(lines: pd.Series) -> pd.DataFrame:
    """scan_line of every line; a null line is an empty one."""
    rows = [scan_line(x or "") for x in lines]
    return pd.DataFrame({"text": [r[0] for r in rows], "strings": [r[1] for r in rows], "cols": [r[2] for r in rows]})


def recover_string(strings: Column, ordinal: Column) -> Column:
    """The literal of an ordinal; null beyond the end."""
    return F.try_element_at(strings, ordinal + 1)


_COMMENT = re.compile(r"/\*.*?\*/", re.S)


@F.pandas_udf(StringType())
def strip_block_comments(source: pd.Series) -> pd.Series:
    """Block comments become spaces of the same length; line ends stay; an open comment stays as it is."""
    return source.map(lambda s: None if s is None else _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), s))


def prefix_for(name: Column) -> Column:
    """What groups a name: before a dot; else _Alnum of a leading underscore; before a space; before a later underscore."""
    dot, space, under = F.instr(name, "."), F.instr(name, " "), F.instr(name, "_")
    lead = F.regexp_extract(name, "^_[A-Za-z0-9]+", 0)
    return F.when(dot > 1, F.substring_index(name, ".", 1)).when(under == 1, F.when(lead != "", lead)).when(space > 1, F.substring_index(name, " ", 1)).when(under > 1, F.substring_index(name, "_", 1))


def word_at(line: Column, at: int) -> Column:
    """The identifier around a place in the line."""
    return F.concat(F.regexp_extract(F.substring(line, 1, at), r"[A-Za-z0-9_]*$", 0), F.regexp_extract(F.substring(line, at + 1, 1 << 30), r"^[A-Za-z0-9_]*", 0))


def split_builtin(name: Column) -> tuple[Column, Column]:
    """Base and parameter of 'Base<Param>'."""
    return F.regexp_extract(name, r"^([^<]*)", 1), F.regexp_extract(name, r"^[^<]*<(.*)>$", 1)


def parse_context(prefix: Column) -> Column:
    """What a completion stands after: cs-ns, cs, this, var or free."""
    return (
        F.when(prefix.rlike(r"cs\.[A-Za-z0-9_]+\.[A-Za-z0-9_]*$"), "cs-ns").when(prefix.rlike(r"cs\.[A-Za-z0-9_]*$"), "cs").when(prefix.rlike(r"(?i)this\.[A-Za-z0-9_]*$"), "this").when(prefix.rlike(r"\$[A-Za-z0-9_]+\.[A-Za-z0-9_]*$"), "var").otherwise("free")
    )


def classify_flavor(name: Column, extends: Column) -> Column:
    """A class's flavor from what it extends, an _I suffix, or the end of its name."""
    e = F.lower(extends)
    return (
        F.when(e == "entity", "Entity").when(e == "entityselection", "EntitySelection").when(e == "datastoreimplementation", "DataStore").when(e == "dataclass", "DataClass").when(name.endswith("_I"), "Interface").when(name.endswith("EntitySelection") | name.endswith("Selection"), "EntitySelection").when(name.endswith("Entity"), "Entity").when(name.endswith("Test"), "Test").otherwise("Class")
    )


def symbol_id(kind: Column, owner: Column, name: Column) -> Column:
    """Kind:Name or Kind:Owner.Name."""
    return F.concat(kind, F.lit(":"), F.when(owner.isNotNull(), F.concat(owner, F.lit("."))).otherwise(""), name)


def signature(params: Column, returns: Column) -> Column:
    """(a : T; b) -> R from an array of structs name, type, variadic."""
    one = F.transform(params, lambda p: F.concat(F.when(p["variadic"], "...").otherwise(""), p["name"], F.when(p["type"].isNotNull(), F.concat(F.lit(" : "), p["type"])).otherwise("")))
    return F.concat(F.lit("("), F.array_join(one, "; "), F.lit(")"), F.when(returns.isNotNull(), F.concat(F.lit(" -> "), returns)).otherwise(""))


def param_structs(params: Column) -> Column:
    """'a : T; b' as an array of structs name, type, variadic; null as none."""
    parts = F.when(params.isNull() | (F.trim(params) == ""), F.array().cast("array<string>")).otherwise(F.split(params, ";"))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_replace(F.split(p, ":")[0], r"^\s*\.\.\.", "")).alias("name"), F.trim(F.try_element_at(F.split(p, ":"), F.lit(2))).alias("type"), F.trim(p).startswith("...").alias("variadic")))


def usage_title(reads: Column, writes: Column) -> Column:
    """'1 read · 2 writes'."""

    def count(n, word):
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))

    return F.concat(count(reads, "read"), F.lit(" · "), count(writes, "write"))


def truncate(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("…"))).otherwise(text)


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def shift_line(line: Column, start: Column, end: Column, added: Column) -> Column:
    """Where a marker's line goes when lines start..end are replaced by text with `added` line ends."""
    return F.when(line > end, line + added - (end - start)).otherwise(line)


def normalize_local_type(name: Column) -> Column:
    """One spelling of a local type; unknown names pass."""
    table = F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv])
    plain = F.trim(name)
    return F.when(F.lower(plain).startswith("cs."), plain).when(plain.rlike(r"^4D\."), plain).otherwise(F.coalesce(F.try_element_at(table, F.lower(plain)), plain))


def should_surface(name: Column, caller_kind: Column) -> Column:
    """Whether an unresolved name is worth a warning: no variables, digits, short or dynamic names, nor calls from forms."""
    return ~(name.startswith("$") | name.startswith("<>") | name.rlike(r"^\d") | (F.length(name) < 3) | F.contains(name, F.lit("(")) | (name == "Super") | caller_kind.isin("Form", "FormMethod"))


#: A directive and its rule ids, which end at a closing comment mark; the text before it must open a comment.
SUPPRESSION = r"^(.*?)\b(lint-disable-next-line|lint-disable-line|lint-disable)\b([^*\n\r`]*)"
#: A plain directive counts for the file only among its first lines.
FILE_LEAD_LINES = 20


def suppressions(line: Column) -> tuple[Column, Column]:
    """Directive of a source line ('next-line', 'line', 'file', or null if there is none or it names no rule) and its rule ids."""
    part = lambda k: F.regexp_extract(line, SUPPRESSION, k)
    ids = F.filter(F.split(part(3), r"[,\s]+"), lambda x: x != "")
    before = part(1)
    commented = F.contains(before, F.lit("//")) | F.contains(before, F.lit("`")) | F.contains(before, F.lit("/*"))
    kind = F.when(part(2) == "lint-disable-next-line", "next-line").when(part(2) == "lint-disable-line", "line").otherwise("file")
    return F.when(line.rlike(SUPPRESSION) & commented & (F.size(ids) > 0), kind), ids


def suppression_map(lines: DataFrame) -> DataFrame:
    """(uri, line, rule_id) that the directives of source lines (uri, line from 0, text) turn off; line is null for the whole file."""
    kind, ids = suppressions(F.col("text"))
    rows = lines.select("uri", "line", kind.alias("kind"), F.explode(ids).alias("rule_id")).filter("kind is not null")
    rows = rows.filter((F.col("kind") != "file") | (F.col("line") < FILE_LEAD_LINES))
    return rows.select("uri", F.when(F.col("kind") == "line", F.col("line")).when(F.col("kind") == "next-line", F.col("line") + 1).alias("line"), "rule_id").distinct()


def canonical_c_type(word: Column) -> Column:
    """The type that a C_<word> declaration names; null for a word that declares none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in C_TYPES.items() for x in kv]), F.lower(word))


def paren_balance(cleaned: Column) -> Column:
    """Opening less closing parentheses of a cleaned line."""
    count = lambda c: F.length(cleaned) - F.length(F.replace(cleaned, F.lit(c), F.lit("")))
    return count("(") - count(")")


def chained(text: str) -> bool:
    """Whether the first `.new(...)` of a cleaned statement is followed by another step, so what is assigned is no new instance."""
    m = re.search(r"(?i)\.new\s*\(", text)
    if not m:
        return False
    depth = 0
    for i in range(m.end() - 1, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return text[i + 1 :].lstrip().startswith(".")
    return False


@F.pandas_udf(BooleanType())
def new_is_chained(cleaned: pd.Series) -> pd.Series:
    """chained() of every statement; null is not."""
    return pd.Series([chained(t or "") for t in cleaned], dtype=bool)


def common_edit(old: str, new: str) -> tuple[int, int, int]:
    """(start, old end, new end) of the one span that differs."""
    a, n = 0, min(len(old), len(new))
    while a < n and old[a] == new[a]:
        a += 1
    b = 0
    while b < n - a and old[len(old) - 1 - b] == new[len(new) - 1 - b]:
        b += 1
    return a, len(old) - b, len(new) - b


@F.pandas_udf(StructType([StructField(n, IntegerType()) for n in ("start", "old_end", "new_end")]))
def compute_edit(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([common_edit(a or "", b or "") for a, b in zip(old, new, strict=True)], columns=["start", "old_end", "new_end"])


def open_call(text: str) -> tuple[str, int] | None:
    """Name and active argument of the innermost open call at the end of the text; strings and comments don't count."""
    clean, depth, commas = scan_line(text)[0], 0, 0
    for i in range(len(clean) - 1, -1, -1):
        c = clean[i]
        if c == ")":
            depth += 1
        elif c == "(":
            if depth == 0:
                m = re.search(r"[$\w.]+$", clean[:i].rstrip())
                return (m[0] if m else "", commas)
            depth -= 1
        elif c == ";" and depth == 0:
            commas += 1
    return None


@F.pandas_udf(StructType([StructField("name", StringType()), StructField("argument", IntegerType())]))
def active_call(text: pd.Series) -> pd.DataFrame:
    found = [open_call(t or "") or (None, None) for t in text]
    return pd.DataFrame({"name": [f[0] for f in found], "argument": pd.array([f[1] for f in found], dtype="Int32")})
