"""Symbols, call sites and blocks of one source, by a token walk; and their table functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import _COMMENT, C_TYPES, chained, scan_line

_TOKEN = re.compile(r"\s*(?:(?P<var>\$\w*)|(?P<ip><>\s*\w+)|(?P<name>[A-Za-z_]\w*)|(?P<num>\d[\w.]*)|(?P<str>\"\d+\")|(?P<op>:=|[+\-*/]=|[^\s\w]))")
# Words that are never calls; commands whose argument names what they run.
RESERVED = {"if", "else", "elseif", "end", "for", "each", "while", "repeat", "until", "case", "of", "begin", "use", "function", "class", "constructor", "try", "catch", "throw", "return", "true", "false", "null", "this", "super", "cs", "ds", "storage", "form", "var", "property", "local", "shared", "extends", "alias"}
DISPATCH = {"call worker": "CallWorker", "new process": "NewProcess", "execute method in subform": "ExecuteMethodInSubform", "execute method": "ExecuteMethodLiteral", "formula from string": "Formula"}
FORM_OPENERS = {"open form window", "dialog", "form load", "print form", "modify selection", "display selection"}
OPENERS = [("if", r"if\s*\("), ("case", r"case\s+of\b"), ("for", r"for(?:\s+each)?\s*\("), ("while", r"while\s*\("), ("repeat", r"repeat\b")]
CLOSERS = [("if", r"end\s+if\b"), ("case", r"end\s+case\b"), ("for", r"end\s+for\b"), ("while", r"end\s+while\b"), ("repeat", r"until\b")]
SITE_COLUMNS = "site_no int, from_id string, line int, column_no int, end_column int, hint_kind string, name string, class_name string, namespace string, variable string, path string, raw string"
_MEMBER = re.compile(r"(?i)(?:(?:local|shared|exposed)\s+)*function\s+(?:(get|set|query|orderby)\s+)?(\w+)\s*(?:\((.*)\))?\s*(?:(?:->|:)\s*(.+))?$")


def clean_source(source: str) -> list[tuple[str, list[str], list[int]]]:
    blank = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    return [scan_line(x) for x in re.split(r"\r?\n", blank)]


#: Places of a joined statement carry their line in the bits above this one.
_LINE = 20
#: Lines that one statement may span; an unclosed bracket joins nothing.
MAX_JOINED = 200


def statements(source: str) -> list[tuple[int, tuple[str, list[str], list[int]]]]:
    """(first line, cleaned text) of every statement: a line, with those that a final backslash or an open bracket joins to it.

    The places of the cleaned text are line << 20 | column of the source.
    """
    lines = clean_source(source)
    depth = [sum(t.count(c) for c in "([{") - sum(t.count(c) for c in ")]}") for t, _, _ in lines]
    out, i = [], 0
    while i < len(lines):
        last, balance = i, depth[i]
        while last + 1 < len(lines) and last - i < MAX_JOINED and (balance > 0 or lines[last][0].rstrip().endswith("\\")):
            last += 1
            balance += depth[last]
        if balance > 0:  # never closed: a statement a line
            last = i
            while last + 1 < len(lines) and lines[last][0].rstrip().endswith("\\"):
                last += 1
        text, strings, cols = "", [], []
        for k in range(i, last + 1):
            t, own, at = lines[k]
            if k < last and t.rstrip().endswith("\\"):
                t = t.rstrip()[:-1]
            if text:
                text, cols = text + " ", [*cols, k << _LINE]
            base = len(strings)
            if base:  # literals are numbered through the statement
                moved, places, done = "", [], 0
                for m in re.finditer(r'"(\d+)"', t):
                    number = f'"{base + int(m[1])}"'
                    moved += t[done : m.start()] + number
                    places += at[done : m.start()] + [at[m.start()]] * len(number)
                    done = m.end()
                t, at = moved + t[done:], places + at[done:]
            text += t
            cols += [k << _LINE | c for c in at[: len(t)]]
            strings += own
            end = at[min(len(t), len(at) - 1)]
        out.append((i, (text, strings, [*cols, last << _LINE | end])))
        i = last + 1
    return out


_TYPED = re.compile(r"\.?\.?\.?\$(\w+)\s*:\s*([\w.]+)")
_NEW = re.compile(r"(?i)\$(\w+)\s*:=\s*(cs|ds)\s*(?:\.\s*(\w+)|\[\s*_?(\w+)\s*\])\s*\.\s*(?:(\w+)\s*\.\s*)?(\w+)\s*\(")
_SELECTS = {"query", "all", "fromcollection", "newselection"}


def local_types(text: str) -> Iterator[tuple[str, str, bool]]:
    """(variable, type, certain) that a cleaned statement declares or assigns; what isn't certain gives way to a declaration.

    Types are named as declared, cs.Class, cs.Space.Class, dsTable:Table or entitySelectionOf:Table.
    """
    if m := re.match(r"(?i)\s*C_(\w+)\s*\(([^)]*)\)", text):
        if kind := C_TYPES.get(m[1].lower()):
            yield from ((v, kind, True) for v in re.findall(r"\$(\w+)", m[2]))
    elif m := re.match(r"(?i)\s*var\s+(.+?)\s*:\s*([\w.]+)", text):
        yield from ((v, m[2], True) for v in re.findall(r"\$(\w+)", m[1]))
    elif re.match(r"(?i)\s*(?:#declare|(?:(?:local|shared)\s+)?function|class\s+constructor)\b", text):
        yield from ((m[1], m[2], True) for m in _TYPED.finditer(text))
    for m in _NEW.finditer(text):
        variable, head, name, bracket, inner, call = m.groups()
        if chained(text[m.start() :]):
            continue
        if head.lower() == "cs" and call.lower() == "new" and name:
            yield variable, f"cs.{name}.{inner}" if inner else f"cs.{name}", bool(inner)
        elif head.lower() == "ds" and not inner and call.lower() == "new":
            yield variable, f"dsTable:{name or bracket}", True
        elif head.lower() == "ds" and not inner and call.lower() in _SELECTS:
            yield variable, f"entitySelectionOf:{name or bracket}", True


_HEADER = re.compile(r"(?i)\s*(?:#declare|(?:(?:local|shared|exposed)\s+)*function|class\s+constructor)\b")


def local_uses(cleaned: tuple[str, list[str], list[int]]) -> Iterator[tuple[str, str, int]]:
    """(variable, use, place) of the local variables of a statement: param, result and var (declared), read or write; a compound assignment is both."""
    line = _Line(cleaned)
    declares = "param" if _HEADER.match(cleaned[0]) else "var" if re.match(r"(?i)\s*(?:var|c_\w+|array\s+\w+)\b", cleaned[0]) else None
    for k, (kind, text, start, _) in enumerate(line.tokens):
        if text == ">" and line.at(k - 1) == "-" and declares == "param":
            declares = "result"
        if kind != "var" or line.at(k - 1) == ".":
            continue
        op = line.at(k + 1)
        if declares in ("param", "result") or (declares and ":=" not in cleaned[0]) or (declares and op in (":", ";", ":=")):
            yield text[1:], declares, start
        if op in (":=", "+=", "-=", "*=", "/="):
            yield text[1:], "write", start
        if op in ("+=", "-=", "*=", "/=") or (op != ":=" and not declares):
            yield text[1:], "read", start


def blocks_of(source: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) lines of control blocks, functions and the class: a closer takes the nearest opener of
    its kind and drops what is open inside it, a bare End the innermost; the end of the text closes the rest."""
    lines = [c[0].strip().lower() for c in clean_source(source)]
    out: list[tuple[str, int, int]] = []
    open_: list[tuple[str, int]] = []
    function, member = None, False
    last = len(lines) - 1

    def close(kind: str, a: int, b: int) -> None:
        if b > a:
            out.append((kind, a, b))

    for i, line in enumerate(lines):
        if re.match(r"(?:(?:local|shared)\s+)?function\b|class\s+constructor\b", line):
            if function is not None:
                close("function", function, i - 1)
            function, member = i, True
        elif kind := next((k for k, p in CLOSERS if re.match(p, line)), None):
            at = max((x for x, o in enumerate(open_) if o[0] == kind), default=None)
            if at is not None:
                close(kind, open_[at][1], i)
                del open_[at:]
        elif re.fullmatch(r"end\s*", line):
            if open_:
                close(*open_.pop(), i)
        elif kind := next((k for k, p in OPENERS if re.match(p, line)), None):
            open_.append((kind, i))
    if function is not None:
        close("function", function, last)
    for kind, a in reversed(open_):
        close(kind, a, last)
    if member:
        close("class", 0, last)
    return out


class _Line:
    """One cleaned line as tokens (kind, text, start, end in the source line)."""

    def __init__(self, cleaned: tuple[str, list[str], list[int]]):
        text, self.strings, cols = cleaned
        self.tokens = [(m.lastgroup, m[m.lastgroup], cols[m.start(m.lastgroup)], cols[min(m.end(m.lastgroup), len(cols) - 1)]) for m in _TOKEN.finditer(text) if m.lastgroup]

    def at(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def close(self, i: int) -> int:
        """The place behind the bracket that closes the one at i."""
        depth = 0
        for k in range(i, len(self.tokens)):
            depth += self.tokens[k][1] in "([{" and self.tokens[k][0] == "op"
            depth -= self.tokens[k][1] in ")]}" and self.tokens[k][0] == "op"
            if depth == 0:
                return k + 1
        return len(self.tokens)

    def literal(self, i: int) -> str | None:
        kind, text = self.tokens[i][:2] if 0 <= i < len(self.tokens) else ("", "")
        return self.strings[int(text[1:-1])] if kind == "str" else None


def sites_of_line(cleaned, constants: set[str], commands: set[str]) -> Iterator[dict]:
    """The call sites of a line. A chain head (variable, This, cs, ds, Super) is followed through its steps;
    other names are commands of up to five words, constants or bare calls."""
    line = _Line(cleaned)
    i, n = 0, len(line.tokens)

    def site(kind: str, k: int, **more) -> dict:
        return {"hint_kind": kind, "column_no": line.tokens[k][2], "end_column": line.tokens[k][3], **more}

    def assigned(k: int) -> str:
        return line.at(k) if line.at(k) in (":=", "+=", "-=", "*=", "/=") else ""

    def chain(head: str, k: int, **more) -> Iterator[dict]:
        """Steps from k (a dot): earlier steps are the path, the last is a call, a read or a write."""
        path: list[str] = []
        while line.at(k) == "." and k + 1 < n and line.tokens[k + 1][0] == "name":
            name, at, nxt = line.at(k + 1), k + 1, k + 2
            called = line.at(nxt) == "("
            if called:
                nxt = line.close(nxt)
            steps = "/".join(path)
            if called:
                yield site(f"{head}Call" if not path else f"{head}ChainCall", at, name=name, path=steps or None, **more)
            elif not path:
                op = assigned(nxt)
                if op != ":=":
                    yield site(f"{head}Get", at, name=name, **more)
                if op:
                    yield site(f"{head}Set", at, name=name, **more)
            path.append(name + ("()" if called else ""))
            k = nxt

    while i < n:
        kind, text = line.tokens[i][:2]
        low = text.lower()
        before = line.at(i - 1)
        if kind == "ip":
            yield site("InterprocessRef", i, name=text[2:].strip())
        elif kind == "var" and before != ".":
            yield from chain("Var", i + 1, variable=text[1:])
        elif kind == "name" and before != ".":
            if low == "this":
                yield from chain("This", i + 1)
            elif low == "super":
                if line.at(i + 1) == "." and line.at(i + 3) == "(":
                    yield site("SuperCall", i + 2, name=line.at(i + 2))
                elif line.at(i + 1) == "(":
                    yield site("SuperCall", i, name=None)
            elif low == "cs" and line.at(i + 1) == ".":
                names, k = [], i + 1
                while line.at(k) == "." and k + 1 < n and line.tokens[k + 1][0] == "name":
                    names.append(line.at(k + 1))
                    k += 2
                    if line.at(k) == "(":
                        break
                if line.at(k) == "(" and len(names) > 1:
                    *space, cls, last = names
                    more = {"class_name": cls} | ({"namespace": space[-1]} if space else {})
                    yield site(("CsNew" if last == "new" else "CsCall") + ("Ns" if space else ""), k - 1, name=None if last == "new" else last, **more)
                    if last == "new":
                        for s in chain("Cs", line.close(k), **more):
                            if s["hint_kind"].endswith("Call"):
                                yield {**s, "hint_kind": "CsChainCall"}
                elif len(names) == 2:
                    op = assigned(k)
                    if op != ":=":
                        yield site("CsGet", k - 1, name=names[1], class_name=names[0])
                    if op:
                        yield site("CsSet", k - 1, name=names[1], class_name=names[0])
            elif low == "ds" and line.at(i + 1) in (".", "["):
                k = i + 4 if line.at(i + 1) == "[" else i + 3
                if line.at(k) == "." and line.at(k + 2) == "(":
                    ident, method = line.at(i + 2), line.at(k + 1)
                    if line.at(i + 1) == ".":
                        yield site("DsCall", k + 1, name=method, class_name=ident)
                    else:
                        yield site("DsBracketNew" if method == "new" else "DsBracketCall", k + 1, name=None if method == "new" else method, class_name=ident)
            else:
                # the longest run of words that is a command or a constant
                words, k, best = [], i, None
                while k < n and len(words) < 5 and line.tokens[k][0] in ("name", "num"):
                    words.append(line.at(k))
                    k += 1
                    phrase = " ".join(words)
                    if phrase.lower() in DISPATCH or phrase.lower() in FORM_OPENERS or phrase in commands or phrase.lower() in constants:
                        best = (phrase, k)
                phrase, k = best or (text, i + 1)
                low = phrase.lower()
                if low in DISPATCH or low in FORM_OPENERS:
                    yield from _dispatch(line, site, i, k, low)
                elif low in constants:
                    yield site("ConstantRef", i, name=phrase)
                elif len(phrase.split()) > 1 or phrase in commands:
                    yield site("BuiltinChain", i, name=phrase)
                elif low not in RESERVED:
                    if line.at(k) == "(":
                        yield site("BareName", i, name=phrase)
                    elif n == 1 or (i == 0 and n == k):
                        yield site("ProjectMethodBare", i, name=phrase)
                i = k
                continue
        i += 1


def _dispatch(line: _Line, site, i: int, k: int, command: str) -> Iterator[dict]:
    """A command that runs what its first arguments name, if they are literals."""
    if line.at(k) != "(":
        return
    end, args, depth = line.close(k), [k + 1], 0
    for j in range(k + 1, end - 1):
        depth += line.at(j) in ("(", "[")
        depth -= line.at(j) in (")", "]")
        if line.at(j) == ";" and depth == 0:
            args.append(j + 1)
    if command in FORM_OPENERS:
        a = args[1] if line.at(args[0]) == "[" and len(args) > 1 else args[0]
        name = line.literal(a)
        if name is not None:
            yield site("FormRef", a, name=name)
        elif line.at(a).startswith("$"):
            yield site("FormRef", a, variable=line.at(a)[1:])
        return
    kind = DISPATCH[command]
    if kind == "ExecuteMethodInSubform":
        form, name = line.literal(args[0]), line.literal(args[1]) if len(args) > 1 else None
        if name is not None:
            yield site(kind, args[1], name=name, class_name=form)
        return
    a = args[1] if kind == "CallWorker" and len(args) > 1 else args[0]
    name = line.literal(a)
    if name is not None:
        yield site(kind, a, name=name)
    elif kind == "ExecuteMethodLiteral" and line.at(a).startswith("$"):
        yield site("ExecuteMethodDynamic", a, variable=line.at(a)[1:])


def extract_source(category: str, container: str | None, base: str, source: str, constants: set[str] = frozenset(), commands: set[str] = frozenset(), only: int | None = None) -> tuple[list[dict], list[dict], list[dict], list[dict]]:
    """Symbols, call sites, types of local variables and uses of these, of a file; `only` names the one of the four that is wanted. A site belongs to the last declaration at or above its line."""
    symbols: list[dict] = []
    sites: list[dict] = []

    def add(kind: str, name: str, line: int, **more) -> str:
        owner = more.get("owner_class")
        symbol = f"{kind}:{owner + '.' if owner else ''}{name}"
        symbols.append({"symbol_id": symbol, "name": name, "kind": kind, "line": line, **more})
        return symbol

    kinds = {"method": "ProjectMethod", "compilerMethod": "CompilerMethod", "databaseMethod": "DatabaseMethod", "formMethod": "FormMethod", "formObjectMethod": "FormObjectMethod", "tableFormMethod": "TableFormMethod", "tableObjectMethod": "TableFormObjectMethod", "class": "Class"}
    name = container if category in ("formMethod", "tableFormMethod", "class") else f"{container}.{base}" if container else base
    owner = add(kinds[category], name, 0)
    bodies = [(symbols[0], 0)]
    types: dict[tuple[str, str], str] = {}
    uses: list[dict] = []
    every = statements(source)
    for no, cleaned in every:
        text = cleaned[0].strip()
        member = False
        if category == "class":
            if m := re.match(r"(?i)class\s+extends\s+(\w+)", text):
                symbols[0]["extends_class"] = m[1]
                continue
            if m := re.match(r"(?i)class\s+constructor\s*(?:\((.*)\))?", text):
                owner, member = add("ClassConstructor", container, no, owner_class=container, params=m[1]), True
            elif m := _MEMBER.match(text):
                kind = {"get": "ClassGetter", "set": "ClassSetter"}.get((m[1] or "").lower(), "ClassFunction")
                owner, member = add(kind, m[2], no, owner_class=container, params=m[3], return_type=m[4]), True
            elif m := re.match(r"(?i)alias\s+(\w+)\s+(\S+)", text):
                add("Alias", m[1], no, owner_class=container)
                continue
            elif m := re.match(r"(?i)property\s+([\w\s;,]+?)\s*(?::\s*(.+))?$", text):
                for one in re.split(r"[;,]", m[1]):
                    add("ClassProperty", one.strip(), no, owner_class=container, return_type=m[2])
                continue
        if member:
            bodies[-1][0]["end_line"] = max(no - 1, bodies[-1][1])
            bodies.append((symbols[-1], no))
        if only in (None, 3):
            uses += [{"from_id": owner, "variable": v, "use": u, "line": at >> _LINE, "column_no": at & ((1 << _LINE) - 1)} for v, u, at in local_uses(cleaned)]
        for variable, kind, certain in local_types(cleaned[0]) if only in (None, 2) else ():
            if certain or (owner, variable) not in types:
                types[owner, variable] = kind
        if member:
            continue
        if m := re.match(r"(?i)#declare\s*\((.*?)\)\s*(?:(?:->|:)\s*(.+))?$", text):
            symbols[0] |= {"params": m[1], "return_type": m[2]}
            continue
        if re.match(r"(?i)(?:var|property|c_\w+)\b", text) and ":=" not in text:
            continue
        for s in sites_of_line(cleaned, constants, commands) if only in (None, 1) else ():
            at, end = s["column_no"], s["end_column"]
            sites.append({"site_no": len(sites), "from_id": owner, "raw": text, **s, "line": at >> _LINE, "column_no": at & ((1 << _LINE) - 1), "end_column": end & ((1 << _LINE) - 1)})
    bodies[-1][0]["end_line"] = len(clean_source(source)) - 1 if every else 0
    if len(bodies) > 1:  # a class lasts to the end of its file
        symbols[0]["end_line"] = bodies[-1][0]["end_line"]
    locals_ = [{"from_id": o, "variable": v, "type": t} for (o, v), t in types.items()]
    return symbols, sites, locals_, uses


def _table(files: DataFrame, which: int, columns: str, constants: set[str], commands: set[str]) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for f in frame.itertuples(index=False):
                if f.content is not None and f.category in ("method", "compilerMethod", "databaseMethod", "formMethod", "formObjectMethod", "tableFormMethod", "tableObjectMethod", "class"):
                    rows += [(f.rel_path, *[x.get(k) for k in names]) for x in extract_source(f.category, f.container, f.base, f.content, constants, commands, which)[which]]
            out = pd.DataFrame(rows, columns=["rel_path", *names])
            for c in columns.split(", "):
                if c.endswith(" int"):
                    out[c.split()[0]] = out[c.split()[0]].astype("Int32")
            yield out

    return files.mapInPandas(run, f"rel_path string, {columns}")


def symbols_of(files: DataFrame) -> DataFrame:
    """Symbols of files (rel_path, category, container, base, content)."""
    return _table(files, 0, "symbol_id string, name string, kind string, line int, owner_class string, extends_class string, params string, return_type string, end_line int", frozenset(), frozenset())


def sites_of(files: DataFrame, constants: set[str] = frozenset(), commands: set[str] = frozenset()) -> DataFrame:
    """Call sites of files; names of constants (lower case) and commands are small sets of the project."""
    return _table(files, 1, SITE_COLUMNS, constants, commands)


def locals_of(files: DataFrame) -> DataFrame:
    """(rel_path, from_id, variable, type) of the local variables whose type a declaration, parameter or assignment tells."""
    return _table(files, 2, "from_id string, variable string, type string", frozenset(), frozenset())


def uses_of(files: DataFrame) -> DataFrame:
    """(rel_path, from_id, variable, use, line, column_no): where local variables are declared (param, result, var), read and written."""
    return _table(files, 3, "from_id string, variable string, use string, line int, column_no int", frozenset(), frozenset())


def blocks_table(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, start_line, end_line) of each source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *b) for k, t in zip(frame["k"], frame["t"], strict=True) if t for b in blocks_of(t)]
            yield pd.DataFrame(rows, columns=["k", "kind", "start_line", "end_line"])

    kind = sources.schema[key].dataType.simpleString()
    return sources.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, kind string, start_line int, end_line int").withColumnRenamed("k", key)
