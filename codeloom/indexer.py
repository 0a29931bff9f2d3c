"""From a project folder to its graph: read, extract, assemble, resolve, deduplicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import extract
from codeloom.functions.text import classify_flavor
from codeloom.index import Index
from codeloom.operators import calls, classes, graph
from codeloom.plans.tables import measured_joins, stored
from codeloom.sources import archives, declared, files
from codeloom.streaming import incremental

SYMBOL_COLUMNS = ["symbol_id", "name", "kind", "uri", "line", "owner_class", "class_flavor", "extends_class", "return_type", "params", "scope"]
# Built-in members of types, by what they return; a project may pass a longer table.
BUILTIN_MEMBERS = {
    "collection": {"push": "collection", "query": "collection", "map": "collection", "filter": "collection", "orderBy": "collection", "length": "integer", "indexOf": "integer", "join": "text", "distinct": "collection", "combine": "collection", "includes": "boolean", "first": "variant", "last": "variant"},
    "entity": {"save": "object", "drop": "object", "reload": "object", "toObject": "object", "touched": "boolean", "isNew": "boolean", "fromObject": "object", "getKey": "variant", "clone": "entity"},
    "entityselection": {"query": "entityselection", "first": "entity", "last": "entity", "length": "integer", "toCollection": "collection", "orderBy": "entityselection", "and": "entityselection", "or": "entityselection", "minus": "entityselection", "drop": "entityselection"},
    "dataclass": {"query": "entityselection", "all": "entityselection", "new": "entity", "get": "entity", "fromCollection": "entityselection", "newSelection": "entityselection"},
}
#: Hints whose target is found by name alone, in the order of what is asked; those without a fallback drop out if nothing is found.
_BY_NAME = {"BareName": ["method", "component", "plugin", "builtin", "prefix"], "BuiltinChain": ["plugin", "builtin"], "ProjectMethodBare": ["method"], "CallWorker": ["method"], "NewProcess": ["method"], "ExecuteMethodLiteral": ["method"], "ConstantRef": ["constant"], "InterprocessRef": ["interprocess"], "FormRef": ["form"]}
#: Hints that run something when the program does, so the call is dynamic even if its target is known.
_DISPATCHED = ["CallWorker", "NewProcess", "ExecuteMethodLiteral", "ExecuteMethodInSubform"]


def project_files(spark: SparkSession, root: str, exclusions: list[str] | None = None) -> DataFrame:
    """(rel_path, content, uri, category, container, base) of a project's text files."""
    rows = files.read_files(spark, root, exclusions, "*.{4dm,4DForm,json,xlf}")
    rows = rows.withColumn("c", files.classify(F.col("rel_path")))
    uri = F.concat(F.lit(f"file://{root.rstrip('/')}/"), F.col("rel_path"))
    return rows.select("rel_path", "content", uri.alias("uri"), "c.category", "c.container", F.regexp_extract("rel_path", r"([^/]+)\.[^./]+$", 1).alias("base"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a number that grows in the given order, made without one task seeing them all; stored, so it is kept."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(sorted_.withColumn(name, F.monotonically_increasing_id()), name)


def _symbol(rows: DataFrame, kind: str, name: Column, uri: Column, line: Column | None = None, rank: int = 0, **more: Column) -> DataFrame:
    """Rows of one kind as symbols; `rank` orders the kinds of sources."""
    owner = more.get("owner_class")
    full = F.concat(F.lit(kind + ":"), F.concat(owner, F.lit(".")) if owner is not None else F.lit(""), name)
    none = F.lit(None).cast("string")
    given = {"symbol_id": more.pop("symbol_id", full), "name": name, "kind": F.lit(kind), "uri": uri, "line": line if line is not None else F.lit(0), **more}
    cols = [given.get(c, none).cast("int" if c == "line" else "string").alias(c) for c in SYMBOL_COLUMNS]
    return rows.select(F.lit(rank).alias("rank"), uri.alias("path"), F.lit(0).alias("no"), *cols)


def assemble(sources: DataFrame, declared_: DataFrame, plugins: DataFrame, components: DataFrame, constants: DataFrame, builtin_constants: DataFrame) -> DataFrame:
    """Numbered symbols of all sources; of those with one id the first counts.

    sources as of `project_files`, declared_ as of `extract.symbols_of` them; plugins (plugin, command), components of `archives.components`,
    constants (name, value, type_letter, theme). Built-in constants give way to the project's own
    of the same name.
    """
    own = declared_.join(sources.select("rel_path", "uri"), "rel_path")
    flavor = F.when(F.col("kind") == "Class", classify_flavor(F.col("name"), F.col("extends_class")))
    parts = [own.select(F.lit(0).alias("rank"), F.col("rel_path").alias("path"), F.coalesce("end_line", F.lit(0)).alias("no"), "symbol_id", "name", "kind", "uri", "line", "owner_class", flavor.alias("class_flavor"), "extends_class", "return_type", "params", F.lit(None).cast("string").alias("scope"))]
    forms = sources.filter("category in ('formDefinition', 'tableFormDefinition')")
    parts.append(_symbol(forms, "Form", F.col("container"), F.col("uri"), rank=1))
    place = F.concat(F.lit("plugin:"), F.col("plugin"))
    parts.append(_symbol(plugins.select("plugin").distinct(), "Plugin", F.col("plugin"), place, rank=2))
    parts.append(_symbol(plugins, "PluginCommand", F.col("command"), place, rank=3))
    place = F.concat(F.lit("component:"), F.col("component"))
    space = components.filter("kind = 'namespace'").select("component", F.col("name").alias("space"))
    inner = components.join(space, "component", "left").withColumn("space", F.coalesce("space", "component"))
    fq = F.concat_ws(".", F.lit("cs"), "space", F.coalesce("class", "name"))
    parts.append(_symbol(components.select("component").distinct(), "Component", F.col("component"), place, rank=4))
    parts.append(_symbol(inner.filter("kind = 'method'"), "ComponentMethod", F.col("name"), place, rank=5))
    parts.append(_symbol(inner.filter("kind = 'class'"), "Class", F.col("name"), place, rank=6, symbol_id=F.concat(F.lit("Class:"), fq), scope=fq))
    parts.append(_symbol(inner.filter("kind = 'constructor'"), "ClassConstructor", F.lit("constructor"), place, rank=7, owner_class=fq))
    parts.append(_symbol(inner.filter("kind = 'function'"), "ClassFunction", F.col("name"), place, rank=8, owner_class=fq))
    known = constants.select(F.lower("name").alias("lc")).distinct()
    others = builtin_constants.withColumn("lc", F.lower("name")).join(known, "lc", "left_anti")
    parts.append(_symbol(constants, "Constant", F.col("name"), F.lit("constants:"), F.lit(-1), rank=9, scope=F.col("theme")))
    parts.append(_symbol(others, "BuiltinConstant", F.col("name"), F.lit("constants:"), F.lit(-1), rank=10, scope=F.col("theme")))
    methods = sources.filter("category in ('method', 'compilerMethod', 'databaseMethod')")
    held = declared.variables(methods).join(sources.select("rel_path", "uri"), "rel_path")
    for scope, kind, rank in (("process", "ProcessVariable", 11), ("interprocess", "InterprocessVariable", 12)):
        parts.append(_symbol(held.filter(F.col("scope") == scope), kind, F.col("name"), F.col("uri"), F.col("line"), rank=rank, return_type=F.col("type"), scope=F.col("scope")))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    first = Window.partitionBy("symbol_id").orderBy("rank", "path", "line", "no")
    rows = rows.withColumn("r", F.row_number().over(first)).filter("r = 1")
    return numbered(rows, ["rank", "path", "line", "no"], "symbol_seq").select("symbol_seq", *SYMBOL_COLUMNS[:2], F.lower("name").alias("name_lc"), *SYMBOL_COLUMNS[2:])


def type_name(kind: Column, entity: Column) -> Column:
    """The lower-case type that a declaration names: a class, space.class, entityselection, or a built-in one.

    `entity` is the entity class of the table that dsTable: and entitySelectionOf: name.
    """
    plain = F.regexp_replace(kind, r"(?i)^(cs|4d)\.", "")
    return F.lower(F.when(kind.startswith("dsTable:"), entity).when(kind.startswith("entitySelectionOf:"), F.lit("entityselection")).when(kind.rlike(r"(?i)^cs\.\w+\.\w+$"), kind).otherwise(plain))


def _members(symbols: DataFrame, builtins: DataFrame) -> DataFrame:
    """(type, key, slot, to_id, depth): what a member of a type is on its class's chain, and behind it on the built-in type of its flavor."""
    up = graph.ancestors(symbols)
    own = classes.member_resolution(symbols, up).select(F.col("class_lc").alias("type"), F.col("name_lc").alias("key"), "slot", F.col("symbol_id").alias("to_id"), "depth")
    flavored = classes.with_self(symbols, up).join(symbols.filter("kind = 'Class' and class_flavor in ('Entity', 'EntitySelection', 'DataClass')").select(F.col("name_lc").alias("ancestor_lc"), F.lower("class_flavor").alias("base")), "ancestor_lc")
    base = flavored.groupBy(F.col("class_lc").alias("type")).agg(F.min_by("base", "depth").alias("base"))
    api = builtins.select(F.col("base"), F.lower("member").alias("key"), F.concat(F.lit("Builtin:"), F.initcap("base"), F.lit("."), F.col("member")).alias("to_id"))
    every = base.union(builtins.select(F.col("base").alias("type"), "base").distinct()).join(api, "base")
    more = every.select("type", "key", F.explode(F.array(F.lit("call"), F.lit("read"))).alias("slot"), "to_id", F.lit(1 << 20).alias("depth"))
    best = Window.partitionBy("type", "key", "slot").orderBy("depth")
    return own.union(more).withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def _steps(symbols: DataFrame, members: DataFrame, builtins: DataFrame) -> DataFrame:
    """(type, step, next): the type behind a property (`name`) or a call (`name()`) of a type."""
    returned = symbols.select(F.col("symbol_id").alias("to_id"), type_name(F.trim("return_type"), F.lit(None).cast("string")).alias("next"))
    builtin = builtins.select(F.concat(F.lit("Builtin:"), F.initcap("base"), F.lit("."), F.col("member")).alias("to_id"), F.col("returns").alias("next"))
    step = F.when(F.col("slot") == "call", F.concat("key", F.lit("()"))).otherwise(F.col("key"))
    return members.filter("slot != 'write'").join(returned.union(builtin), "to_id").filter("next is not null").select("type", step.alias("step"), "next")


def resolve(sites: DataFrame, symbols: DataFrame, locals_: DataFrame, tables: DataFrame, commands: DataFrame, prefixes: DataFrame, builtins: DataFrame) -> DataFrame:
    """Edges (from_id, to_id, call_kind, line, column_no, raw, resolved, access, receiver) of call sites.

    Every site names what it may mean as keys (space, key) with a rank; all lookups are one table of
    such keys, so each hint is the same join, and the lowest rank that is found holds. What isn't
    found becomes an Unresolved symbol of the site's label, or drops out, as its hint says.
    """
    members = stored(_members(symbols, builtins), "members")
    steps = stored(_steps(symbols, members, builtins), "steps")
    kinds = symbols.select("symbol_id", "symbol_seq", "kind", "name", "name_lc", "owner_class", "scope")
    pick = lambda kind: kinds.filter(F.col("kind").isin(kind) if isinstance(kind, list) else F.col("kind") == kind)
    entity = tables.select(F.lower("name").alias("table_lc")).distinct()
    owned = pick("Class").filter("scope is null").select(F.col("name_lc").alias("entity_lc"), "symbol_id", "name")
    # a table's class: its name with Entity behind it
    entity = entity.join(owned.select("entity_lc"), F.concat("table_lc", F.lit("entity")) == F.col("entity_lc"), "left")
    target = lambda rows, space, key, to="symbol_id": rows.select(F.lit(space).alias("space"), key.alias("key"), F.col(to).alias("to_id"), "symbol_seq")
    lc, made = F.col("name_lc"), pick("ClassConstructor").filter("owner_class is not null")
    found = [
        target(pick(["ProjectMethod", "DatabaseMethod"]), "method", lc), target(pick("ComponentMethod"), "component", F.col("name")), target(pick("PluginCommand"), "plugin", F.col("name")),
        target(pick(["Constant", "BuiltinConstant", "ProcessVariable"]), "constant", lc), target(pick("InterprocessVariable"), "interprocess", lc), target(pick("Form"), "form", F.col("name")),
        target(pick("FormObjectMethod"), "object", lc), target(pick("Class").filter("scope is null"), "class", lc), target(pick("Class").filter("scope is not null"), "class", F.lower("scope")),
        target(made, "constructor", F.lower("owner_class")), target(pick("ClassFunction").filter("owner_class like 'cs.%'"), "call", F.concat(F.lower("owner_class"), F.lit("/"), lc)),
        commands.select(F.lit("builtin").alias("space"), F.col("name").alias("key"), F.concat(F.lit("Builtin:"), "name").alias("to_id"), F.lit(0).cast("long").alias("symbol_seq")),
        tables.select(F.lit("table").alias("space"), F.lower("name").alias("key"), F.lit("table:").alias("to_id"), F.lit(0).cast("long").alias("symbol_seq")),
        members.select("slot", F.concat("type", F.lit("/"), "key").alias("key"), "to_id", F.col("depth").cast("long").alias("symbol_seq")),
    ]
    dims = found[0]
    for x in found[1:]:
        dims = dims.union(x)
    dims = dims.groupBy("space", "key").agg(F.min(F.struct("symbol_seq", "to_id")).alias("t")).select("space", "key", "t.to_id", F.col("t.symbol_seq").alias("depth"))

    owners = symbols.select(F.col("symbol_id").alias("from_id"), F.lower("owner_class").alias("own"))
    parents = symbols.filter("kind = 'Class' and extends_class is not null").groupBy(F.col("name_lc").alias("own")).agg(F.min_by(F.lower("extends_class"), "symbol_seq").alias("parent"))
    typed = locals_.withColumn("table_lc", F.lower(F.regexp_extract("type", r":(\w+)$", 1))).join(entity, "table_lc", "left")
    own_class = F.when(F.col("type").rlike(r"(?i)^cs\."), F.regexp_replace("type", r"(?i)^cs\.", ""))
    typed = typed.select("from_id", "variable", type_name(F.col("type"), F.coalesce("entity_lc", "table_lc")).alias("typ"), own_class.alias("named"))
    rows = sites.withColumn("site", F.monotonically_increasing_id())
    rows = stored(rows.join(owners, "from_id", "left").join(parents, "own", "left").join(typed, ["from_id", "variable"], "left"), "sites")
    hint, name = F.col("hint_kind"), F.lower("name")

    # the type at which a member is looked up: chains are walked step by step
    head = F.when(hint.startswith("This"), F.col("own")).when(hint.startswith("Var"), F.col("typ")).when(hint == "SuperCall", F.col("parent")).when(hint.isin("CsCall", "CsGet", "CsSet", "CsChainCall", "DsCall"), F.lower("class_name")).when(hint.isin("DsBracketCall", "DsBracketNew"), F.concat(F.lower(F.regexp_replace("class_name", "^_", "")), F.lit("entity"))).when(hint.endswith("Ns"), F.lower(F.concat_ws(".", F.lit("cs"), "namespace", "class_name")))
    path = F.when(F.coalesce("path", F.lit("")) != "", F.transform(F.split("path", "/"), lambda x: F.lower(x))).otherwise(F.array().cast("array<string>"))
    at = rows.select("*", head.alias("at"), path.alias("way"))
    longest = at.agg(F.coalesce(F.max(F.size("way")), F.lit(0))).first()[0]
    for k in range(longest):
        hop = steps.select(F.col("type").alias("at"), F.col("step").alias("hop"), "next")
        at = at.withColumn("hop", F.try_element_at("way", F.lit(k + 1))).join(hop, ["at", "hop"], "left")
        at = at.withColumn("at", F.when(F.size("way") > k, F.col("next")).otherwise(F.col("at"))).drop("hop", "next")
    at = stored(at, "typed")

    bare = F.regexp_replace("class_name", "^_", "")
    member = lambda space: F.struct(F.lit(space).alias("space"), F.concat("at", F.lit("/"), F.coalesce(name, F.lit("constructor"))).alias("key"))
    one = lambda space, key: F.struct(F.lit(space).alias("space"), key.alias("key"))
    asks = F.when(F.lit(False), F.array(one("", F.lit(""))))
    for kind, spaces in _BY_NAME.items():
        asks = asks.when(hint == kind, F.array(*[one(s, name if s in ("method", "constant", "interprocess") else F.col("name")) for s in spaces if s != "prefix"]))
    # a class that declares no constructor is itself what a construction runs
    cls = F.when(hint == "CsNewNs", F.col("at")).otherwise(F.lower("class_name"))
    asks = asks.when(hint == "ExecuteMethodInSubform", F.array(one("object", F.lower(F.concat_ws(".", "class_name", "name"))), one("method", name)))
    asks = asks.when(hint.isin("CsNew", "CsNewNs"), F.array(one("constructor", cls), one("class", cls)))
    asks = asks.when(hint == "DsBracketNew", F.array(one("constructor", F.col("at")), one("class", F.col("at")), one("table", F.lower(bare))))
    asks = asks.when(hint == "DsBracketCall", F.array(member("call"), one("table", F.lower(bare))))
    asks = asks.when(hint == "CsCallNs", F.array(member("call"), one("class", F.col("at"))))
    asks = asks.when((hint == "SuperCall") & F.col("name").isNull(), F.array(one("constructor", F.col("parent"))))
    asks = asks.when(hint.rlike("(Get|GetNs)$"), F.array(member("read"))).when(hint.rlike("(Set|SetNs)$"), F.array(member("write"))).when(hint.rlike("Call$"), F.array(member("call")))
    asked = at.select("*", asks.alias("asks"))
    # a chain begins with a construction, which is a call of its own; a bracket names a constant
    extra = asked.filter(hint == "CsChainCall").withColumn("hint_kind", F.lit("CsNew")).withColumn("asks", F.array(one("constructor", F.lower("class_name")), one("class", F.lower("class_name")))).withColumn("side", F.lit(1))
    named = asked.filter(hint.isin("DsBracketNew", "DsBracketCall")).withColumn("hint_kind", F.lit("ConstantRef")).withColumn("asks", F.array(one("constant", F.lower("class_name")))).withColumn("side", F.lit(2))
    asked = stored(asked.withColumn("side", F.lit(0)).union(extra).union(named).withColumn("no", F.monotonically_increasing_id()), "asked")
    hits = asked.select("no", F.posexplode("asks").alias("rank", "ask")).select("no", "rank", "ask.*").join(dims, ["space", "key"])
    hits = hits.groupBy("no").agg(F.min(F.struct("rank", "space", "to_id", "depth")).alias("hit"))
    out = asked.join(hits, "no", "left")

    prefix = _begins(asked.filter(hint == "BareName"), prefixes)
    out = out.join(prefix, "no", "left")
    chained = F.when(F.size("way") > 0, F.concat(F.array_join(F.split("path", "/"), "."), F.lit("."))).otherwise(F.lit(""))
    dollar = F.concat(F.lit("$"), F.col("variable"))
    label = (
        F.when(hint.isin("BareName", "CallWorker", "NewProcess", "ExecuteMethodLiteral"), F.col("name")).when(hint == "ExecuteMethodDynamic", F.concat(F.lit("EXECUTE_METHOD("), dollar, F.lit(")")))
        .when(hint == "ExecuteMethodInSubform", F.concat_ws(".", "class_name", "name")).when(hint == "CsNew", F.concat(F.lit("cs."), F.col("class_name"), F.lit(".new")))
        .when(hint == "CsNewNs", F.concat(F.lit("cs."), F.col("namespace"), F.lit("."), F.col("class_name"), F.lit(".new"))).when(hint == "CsCall", F.concat_ws(".", F.lit("cs"), "class_name", "name"))
        .when(hint == "CsCallNs", F.concat_ws(".", F.lit("cs"), "namespace", "class_name", "name")).when(hint.isin("ThisCall", "ThisChainCall"), F.concat(F.lit("This."), chained, F.col("name")))
        .when(hint == "SuperCall", F.lit("Super")).when(hint.isin("VarCall", "VarChainCall"), F.concat(dollar, F.lit("."), chained, F.col("name")))
        .when(hint == "CsChainCall", F.concat(F.lit("cs."), F.col("class_name"), F.lit(".new."), chained, F.col("name")))
        .when(hint == "DsBracketNew", F.concat(F.lit("ds["), F.col("class_name"), F.lit("].new"))).when(hint == "DsBracketCall", F.concat(F.lit("ds["), F.col("class_name"), F.lit("]."), F.col("name")))
    )
    builtin = F.concat(F.lit("TableBuiltin:ds."), F.when(hint == "DsCall", F.col("class_name")).otherwise(bare), F.lit("."), F.coalesce("name", F.lit("new")))
    known_type = (hint == "VarCall") & F.col("named").isNotNull()
    to = (
        F.when(F.col("hit.space") == "table", builtin).when(F.col("hit").isNotNull(), F.col("hit.to_id")).when(hint == "DsCall", builtin)
        .when(F.col("begins"), F.concat(F.lit("Builtin:"), F.col("name"))).when(known_type, F.concat(F.lit("Builtin:"), F.col("named"), F.lit("."), F.col("name")))
    )
    resolved = to.isNotNull()
    inherited = (hint == "SuperCall") | (hint.isin("ThisCall", "ThisGet", "ThisSet") & F.col("hit.depth").between(1, (1 << 20) - 1))
    call_kind = F.when(~resolved | hint.isin(_DISPATCHED), "Dynamic").when(inherited, "Inherited").otherwise("Static")
    access = F.when(hint.rlike("Get(Ns)?$"), "read").when(hint.rlike("Set(Ns)?$"), "write")
    receiver = F.when(hint.isin("ThisCall", "ThisGet", "ThisSet") & ~F.coalesce(F.col("hit.depth") == 1 << 20, F.lit(False)), "this").when(hint == "SuperCall", "super")
    out = out.select("rel_path", "site_no", "side", "from_id", F.coalesce(to, F.concat(F.lit("Unresolved:"), label)).alias("to_id"), call_kind.alias("call_kind"), "line", F.col("column_no").cast("long").alias("column_no"), "raw", resolved.alias("resolved"), F.when(resolved, access).alias("access"), receiver.alias("receiver"))
    return out.filter("to_id is not null")


def _begins(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(no, begins) of rows whose name begins with a plugin's prefix."""
    sizes = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]  # lengths, not rows
    if not sizes:
        return rows.select("no", F.lit(True).alias("begins")).limit(0)
    asks = rows.select("no", F.explode(F.array(*[F.substring("name", 1, n) for n in sizes])).alias("prefix"))
    return asks.join(prefixes, "prefix", "left_semi").select("no").distinct().withColumn("begins", F.lit(True))


def synthetics(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of the targets that no source declares: Builtin, TableBuiltin and Unresolved ones, numbered behind all others."""
    made = edges.select(F.col("to_id").alias("symbol_id")).distinct().join(symbols.select("symbol_id"), "symbol_id", "left_anti")
    name = F.expr("substring(symbol_id, instr(symbol_id, ':') + 1)")
    none = F.lit(None).cast("string")
    rows = made.select(F.lit(None).cast("long").alias("symbol_seq"), "symbol_id", name.alias("name"), F.lower(name).alias("name_lc"), F.substring_index("symbol_id", ":", 1).alias("kind"), F.lit("synthetic:").alias("uri"), F.lit(-1).alias("line"), *[none.alias(c) for c in SYMBOL_COLUMNS[5:]])
    return numbered(rows.drop("symbol_seq"), ["symbol_id"], "k").withColumn("symbol_seq", F.col("k") + F.lit(1 << 60)).select(*symbols.columns)


def builtin_table(spark: SparkSession, members: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(base, member, returns) of built-in types."""
    return spark.createDataFrame([(b, m, r) for b, own in (members or BUILTIN_MEMBERS).items() for m, r in own.items()], "base string, member string, returns string")


@dataclass
class Project:
    """All that is kept of a project between changes: stored tables by path, and the graph made of them.

    `links` are the resolved sites before sites are made one: edges with rel_path, site_no and side.
    """

    sources: DataFrame
    declared: DataFrame
    sites: DataFrame
    locals_: DataFrame
    symbols: DataFrame
    links: DataFrame
    index: Index
    names: frozenset[str]
    options: dict


def _code(sources: DataFrame) -> DataFrame:
    return sources.filter("rel_path like '%.4dm'")


def _extracted(sources: DataFrame, constants: frozenset[str], commands: set[str]) -> tuple[DataFrame, DataFrame]:
    """Stored call sites and local types of sources."""
    code = _code(sources)
    sites = extract.sites_of(code, set(constants), commands)
    forms = archives.form_sites(sources.filter("category in ('formDefinition', 'tableFormDefinition')"))
    forms = forms.join(sources.select("rel_path", F.concat(F.lit("Form:"), "container").alias("from_id")), "rel_path")
    for field in sites.schema.fields:
        if field.name not in forms.columns:
            forms = forms.withColumn(field.name, F.lit(None).cast(field.dataType))
    forms = forms.withColumn("site_no", F.lit(0)).select(sites.columns)
    return stored(sites.unionByName(forms), "sites"), stored(extract.locals_of(code), "locals")


def _symbols(sources: DataFrame, declared_: DataFrame, options: dict) -> DataFrame:
    spark = sources.sparkSession
    components, builtin = options.get("component_rows"), options.get("builtin_constants")
    none = "component string, kind string, class string, name string, type string"
    xliff = sources.filter("rel_path rlike '(?i)^Resources/Constants_[^/]*[.]xlf$'")
    return assemble(
        sources, declared_, files.plugin_commands(sources), components if components is not None else spark.createDataFrame([], none),
        archives.xliff_constants(xliff), builtin if builtin is not None else spark.createDataFrame([], "name string, value string, type_letter string, theme string"),
    )


def _names(symbols: DataFrame) -> frozenset[str]:
    """Names that a bare word may mean besides a call: the project's constants and process variables."""
    return frozenset(r[0] for r in symbols.filter("kind in ('Constant', 'BuiltinConstant', 'ProcessVariable')").select("name_lc").distinct().collect())


def _links(sites: DataFrame, symbols: DataFrame, locals_: DataFrame, sources: DataFrame, options: dict) -> DataFrame:
    spark = sources.sparkSession
    own = spark.createDataFrame([(c,) for c in options.get("commands") or []], "name string")
    short = spark.createDataFrame([(p,) for p in options.get("prefixes") or []], "prefix string")
    return resolve(sites, symbols, locals_, files.table_names(sources), own, short, builtin_table(spark, options.get("members")))


def _project(sources: DataFrame, declared_: DataFrame, sites: DataFrame, locals_: DataFrame, symbols: DataFrame, links: DataFrame, names: frozenset[str], options: dict) -> Project:
    edges = numbered(links, ["rel_path", "site_no", "side"], "edge_seq").drop("rel_path", "site_no", "side")
    edges = stored(calls.dedup_edges(edges), "edges")
    return Project(sources, declared_, sites, locals_, symbols, links, Index(stored(symbols.unionByName(synthetics(edges, symbols)), "symbols"), edges), names, options)


def build(sources: DataFrame, **options) -> Project:
    """The project of all sources (as of `project_files`).

    Options: component_rows as of `archives.components`; `commands`, the names of built-in commands;
    `prefixes` of plugin commands without a manifest; builtin_constants; `members` of built-in
    types. Names of commands and constants go to the tasks that read the sources: they are the
    language's and the project's, not its code's.
    """
    spark = sources.sparkSession
    with measured_joins(spark):
        # dealt out, since many small sources may come from one small file
        sources = stored(sources.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rel_path"), "sources")
        declared_ = stored(extract.symbols_of(_code(sources)), "declared")
        symbols = _symbols(sources, declared_, options)
        names = _names(symbols)
        sites, locals_ = _extracted(sources, names, _commands(sources, options))
        return _project(sources, declared_, sites, locals_, symbols, stored(_links(sites, symbols, locals_, sources, options), "links"), names, options)


def _commands(sources: DataFrame, options: dict) -> set[str]:
    return {r[0] for r in files.plugin_commands(sources).select("command").distinct().collect()} | set(options.get("commands") or [])


def patch(project: Project, changes: DataFrame, new: DataFrame) -> Project:
    """The project after a batch of changes (path, kind): that of `build` over the new sources.

    `new` has the sources of created and changed paths. Only these are read again; only their sites
    and those elsewhere that a symbol which came, went or changed may concern are resolved again. A
    batch with other files than code, or that changes the names of constants, is built anew.
    """
    with measured_joins(project.sources.sparkSession):
        changes = stored(changes.select("path", "kind"), "changes")
        paths = changes.select(F.col("path").alias("rel_path"))
        sources = incremental.apply_batch(project.sources.withColumnRenamed("rel_path", "path"), changes, new.select(*project.sources.columns).withColumnRenamed("rel_path", "path")).withColumnRenamed("path", "rel_path")
        if not changes.filter("path not like '%.4dm'").isEmpty():
            return build(sources, **project.options)
        sources = stored(sources, "sources")
        changed = sources.join(paths, "rel_path", "left_semi")
        fresh = (stored(extract.symbols_of(_code(changed)), "declared"), *_extracted(changed, project.names, _commands(sources, project.options)))
        declared_, sites, locals_ = (stored(_swapped(old, changes, now), "patched") for old, now in zip((project.declared, project.sites, project.locals_), fresh, strict=True))
        symbols = _symbols(sources, declared_, project.options)
        if _names(symbols) != project.names:
            return build(sources, **project.options)

        again = affected(sites, locals_, project.symbols, symbols, changes)
        links = _links(sites.join(again, ["rel_path", "site_no"], "left_semi"), symbols, locals_, sources, project.options)
        gone = again.union(project.sites.select("rel_path", "site_no").join(paths, "rel_path", "left_semi")).distinct()
        kept = project.links.join(gone, ["rel_path", "site_no"], "left_anti")
        return _project(sources, declared_, sites, locals_, symbols, stored(kept.unionByName(links), "links"), project.names, project.options)


def _swapped(old: DataFrame, changes: DataFrame, new: DataFrame) -> DataFrame:
    paths = changes.select(F.col("path").alias("rel_path"))
    return old.join(paths, "rel_path", "left_anti").unionByName(new)


def affected(sites: DataFrame, locals_: DataFrame, before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored (rel_path, site_no) of sites to resolve again: those of changed files, and those that depend on a changed symbol.

    A site depends on the names that it uses: its own, its class, its space, the steps of its path and
    its variable's type. A class that changed concerns all members looked up on it or below it, and
    every chain, since what a chain's steps give isn't known before it is walked.
    """
    with measured_joins(sites.sparkSession):
        columns = [c for c in SYMBOL_COLUMNS if c not in ("uri", "line", "params")]
        content = lambda x: x.select("name_lc", *columns).distinct()
        a, b = content(before), content(after)
        changed = stored(a.exceptAll(b).union(b.exceptAll(a)), "changed")
        classes_ = changed.filter("kind = 'Class'").select("name_lc")
        keys = changed.select(F.col("name_lc").alias("key")).union(changed.filter("kind = 'FormObjectMethod'").select(F.substring_index("name_lc", ".", -1)))
        below = [graph.ancestors(x).join(classes_.select(F.col("name_lc").alias("ancestor_lc")), "ancestor_lc", "left_semi").select(F.col("class_lc").alias("key")) for x in (before, after)]
        hot = stored(classes_.select(F.col("name_lc").alias("key")).union(below[0]).union(below[1]).distinct(), "hot")
        keys = keys.union(changed.filter("kind = 'ClassConstructor'").select(F.lower("owner_class"))).distinct()
        types = locals_.select("from_id", "variable", F.lower(F.regexp_extract("type", r"(\w+)$", 1)).alias("typ"))
        owners = after.select(F.col("symbol_id").alias("from_id"), F.lower("owner_class").alias("own"))
        rows = sites.join(types, ["from_id", "variable"], "left").join(owners, "from_id", "left")
        # a table stands for its entity class
        heads = F.array_compact(F.array(F.lower(F.regexp_replace("class_name", "^_", "")), F.concat(F.lower(F.regexp_replace("class_name", "^_", "")), F.lit("entity")), "typ", F.concat("typ", F.lit("entity")), "own"))
        used = F.concat(F.array_compact(F.array(F.lower("name"), F.lower("class_name"))), F.transform(F.split(F.coalesce(F.regexp_replace("path", r"\(\)", ""), F.lit("")), "/"), lambda x: F.lower(x)))
        rows = rows.select("rel_path", "site_no", used.alias("used"), heads.alias("heads"), (F.coalesce("path", F.lit("")) != "").alias("chain"))
        by_name = rows.select("rel_path", "site_no", F.explode("used").alias("key")).join(keys, "key", "left_semi").select("rel_path", "site_no")
        by_class = rows.select("rel_path", "site_no", F.explode("heads").alias("key")).join(hot, "key", "left_semi").select("rel_path", "site_no")
        out = by_name.union(by_class)
        if not hot.isEmpty():
            out = out.union(rows.filter("chain").select("rel_path", "site_no"))
        mine = sites.join(changes.select(F.col("path").alias("rel_path")), "rel_path", "left_semi").select("rel_path", "site_no")
        return stored(out.union(mine).distinct(), "again")


def index_sources(sources: DataFrame, **options) -> Index:
    """The graph of project files (as of `project_files`); see `build`."""
    return build(sources, **options).index


def index_project(spark: SparkSession, root: str, exclusions: list[str] | None = None, **options) -> Index:
    """The graph of the project below root; see `build` for the options."""
    return index_sources(project_files(spark, root, exclusions), **options)
