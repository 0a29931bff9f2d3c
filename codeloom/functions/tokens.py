"""A tokenizer of the analysed language: 17 kinds, with block comments carried over lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of the language.
KEYWORDS = {"if", "else", "end", "case", "of", "for", "each", "while", "repeat", "until", "begin", "use", "try", "catch", "throw", "return", "break", "continue", "function", "class", "constructor", "extends", "var", "property", "alias", "local", "shared", "true", "false", "null"}
PHRASES = ["end if", "end case", "end for each", "end for", "end while", "end use", "end try", "for each", "case of", "class constructor", "class extends"]
GLOBALS = {"this", "super", "form", "cs", "ds", "storage"}
_LEX = re.compile(r"""(?P<comment>//.*|`.*|/\*.*?\*/)|(?P<string>"(?:[^"]|"")*"?)|(?P<interprocessVar><>\s*\w+)|(?P<parameter>\$\d+\b|\$\{\d+\})|(?P<localVar>\$\w+)|(?P<fieldRef>\[[^\]\n]+\]\w+)|(?P<tableRef>\[[A-Za-z_][^\]\n]*\])|(?P<number>\d+(?:\.\d+)?)|(?P<word>[^\W\d]\w*)|(?P<operator>:=|[-+*/]=|->|<=|>=|[-+*/%^=#<>&|?!:;.,(){}\[\]])""")


def tokenize(source: str, variables: set[str] = frozenset(), plugins: set[str] = frozenset(), commands: set[str] = frozenset()) -> Iterator[tuple[int, int, int, str]]:
    """(line, start, length, kind). Variables, plugin commands and commands are lower case; the longest phrase of words wins."""
    named = {**dict.fromkeys(commands, "builtinCommand"), **dict.fromkeys(plugins, "pluginCommand"), **dict.fromkeys(PHRASES, "keyword")}
    inside = False
    for no, line in enumerate(re.split(r"\r?\n", source)):
        at, before, typed = 0, "", False
        if inside:
            end = line.find("*/")
            stop = len(line) if end < 0 else end + 2
            if stop:
                yield no, 0, stop, "comment"
            inside, at = end < 0, stop
        while at < len(line):
            if line.startswith("/*", at) and "*/" not in line[at + 2 :]:
                yield no, at, len(line) - at, "comment"
                inside = True
                break
            m = _LEX.match(line, at)
            if not m:
                at += 1
                continue
            kind, text = m.lastgroup, m[0]
            if kind == "word":
                low = text.lower()
                kind = "identifier"
                if before == ".":
                    kind = "property"
                elif typed:
                    kind = "type"
                else:
                    ends = [at + len(text)]
                    for more in re.finditer(r"\s+\w+", line[at + len(text) :]):
                        if more.start() != ends[-1] - at - len(text) or len(ends) == 5:
                            break
                        ends.append(at + len(text) + more.end())
                    for end in reversed(ends):
                        phrase = " ".join(line[at:end].lower().split())
                        if phrase in named:
                            kind, text = named[phrase], line[at:end]
                            break
                    else:
                        kind = "keyword" if low in KEYWORDS else "builtinGlobal" if low in GLOBALS else "processVar" if low in variables else kind
            if kind != "comment":
                typed = text == ":" or (typed and text == ".")
                before = text
            yield no, m.start(), len(text), kind
            at = m.start() + len(text)


def tokens_table(sources: DataFrame, key: str, text: str, variables: set[str] = frozenset(), plugins: set[str] = frozenset(), commands: set[str] = frozenset()) -> DataFrame:
    """(key, line, start, length, kind) of each source; the name sets are a project's own, so small."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *t) for k, s in zip(frame["k"], frame["t"], strict=True) if s for t in tokenize(s, variables, plugins, commands)]
            yield pd.DataFrame(rows, columns=["k", "line", "start", "length", "kind"])

    kind = sources.schema[key].dataType.simpleString()
    return sources.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, line int, start int, length int, kind string").withColumnRenamed("k", key)
