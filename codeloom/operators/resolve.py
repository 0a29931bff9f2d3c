"""Resolution of call sites: priority-ordered lookup joins.

Lookup tables are dimensions; Spark broadcasts the ones it knows to be small. A site keeps one
target, that of the first rank that has its key; a miss drops the site or makes a synthetic
Unresolved target, as the hint's rule says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: str, order: list[Column | str], target: str = "to_id") -> DataFrame:
    """A dimension (key, target) where the first row of a key wins."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select(key, target)


def by_priority(sites: DataFrame, lookups: list[tuple[Column, DataFrame]], miss: Column | None) -> DataFrame:
    """sites with to_id of the first lookup (site expression, dimension key/to_id) that has it.

    With `miss`, other sites get that id and resolved = false; without, they are dropped.
    """
    out, found = sites, []
    for k, (expr, dim) in enumerate(lookups):
        out = out.withColumn(f"__k{k}", expr).join(dim.select(F.col("key").alias(f"__k{k}"), F.col("to_id").alias(f"__t{k}")), f"__k{k}", "left")
        found.append(F.col(f"__t{k}"))
    hit = F.coalesce(*found)
    out = out.withColumn("resolved", hit.isNotNull()).withColumn("to_id", F.coalesce(hit, miss) if miss is not None else hit)
    out = out.drop(*[f"__{c}{k}" for k in range(len(lookups)) for c in "kt"])
    return out if miss is not None else out.filter("resolved")


def has_prefix(sites: DataFrame, name: str, prefixes: DataFrame) -> DataFrame:
    """(site_no): sites whose name begins with any of the prefixes (column key).

    Prefixes are few; each site asks an equality for every prefix length there is, so the join is no
    nested loop.
    """
    sizes = [r[0] for r in prefixes.select(F.length("key")).distinct().collect()]  # lengths, not rows
    if not sizes:
        return sites.select("site_no").limit(0)
    asks = sites.select("site_no", F.explode(F.array(*[F.substring(name, 1, n) for n in sizes])).alias("key"))
    return asks.join(prefixes.select("key"), "key", "left_semi").select("site_no").distinct()


def bare_names(sites: DataFrame, name: str, methods: DataFrame, components: DataFrame, plugins: DataFrame, builtins: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Project or database method (any case), component method, plugin command, builtin, a builtin of its own name for a
    plugin's prefix; else Unresolved and Dynamic."""
    prefix = has_prefix(sites, name, prefixes).join(sites.select("site_no", F.col(name).alias("n")), "site_no").select(F.col("site_no").alias("key"), F.concat(F.lit("Builtin:"), F.col("n")).alias("to_id"))
    out = by_priority(sites, [(F.lower(name), methods), (F.col(name), components), (F.col(name), plugins), (F.col(name), builtins), (F.col("site_no"), prefix)], F.concat(F.lit("Unresolved:"), F.col(name)))
    return out.withColumn("call_kind", F.when(F.col("resolved"), "Static").otherwise("Dynamic"))


def method_dimension(symbols: DataFrame) -> DataFrame:
    """(key, to_id): project and database methods by lower-case name; of equal names the first counts."""
    rows = symbols.filter(F.col("kind").isin("ProjectMethod", "DatabaseMethod")).select(F.col("name_lc").alias("key"), F.col("symbol_id").alias("to_id"), "symbol_seq")
    return first_of(rows, "key", ["symbol_seq"])


def on_class(sites: DataFrame, resolution: DataFrame, miss: Column | None, own: str = "class_lc") -> DataFrame:
    """sites (class, name_lc, slot) with what the member resolves to on the class's chain; Static on the class itself, else Inherited."""
    table = resolution.select(F.col("class_lc").alias(own), "name_lc", "slot", F.col("symbol_id").alias("hit"), F.col("depth").alias("at"))
    out = sites.join(table, [own, "name_lc", "slot"], "left").withColumn("resolved", F.col("hit").isNotNull()).withColumn("call_kind", F.when(F.col("at") == 0, "Static").when(F.col("at") > 0, "Inherited").otherwise("Dynamic"))
    out = out.withColumn("to_id", F.coalesce("hit", miss) if miss is not None else F.col("hit")).drop("hit", "at")
    return out if miss is not None else out.filter("resolved")


def walk_chain(sites: DataFrame, prop_types: DataFrame, ancestors: DataFrame, max_steps: int | None = None) -> DataFrame:
    """sites (class_lc, path array) with the class at the end of the path: each step takes the type of the
    nearest declaration of the property on the chain; an unknown step gives null.

    Without `max_steps` (which must not be less) the longest path is found first.
    """
    if max_steps is None:
        max_steps = sites.agg(F.max(F.size("path"))).first()[0] or 0
    near = ancestors.join(prop_types.select(F.col("class_lc").alias("ancestor_lc"), "member", "type_lc"), "ancestor_lc")
    w = Window.partitionBy("class_lc", "member").orderBy("depth")
    table = near.withColumn("r", F.row_number().over(w)).filter("r = 1").select("class_lc", "member", "type_lc")
    out = sites.withColumn("at", F.col("class_lc"))
    for k in range(max_steps):
        step = table.select(F.col("class_lc").alias("at"), F.col("member").alias("__m"), F.col("type_lc").alias("__next"))
        out = out.withColumn("__m", F.try_element_at("path", F.lit(k + 1))).join(step, ["at", "__m"], "left")
        out = out.withColumn("at", F.when(F.size("path") <= k, F.col("at")).otherwise(F.col("__next"))).drop("__m", "__next")
    return out.withColumnRenamed("at", "end_lc")


def synthetic_symbols(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, kind, origins): targets that are no real symbol, each with the number of callers that make it."""
    made = edges.select(F.col("to_id").alias("symbol_id"), "from_id").distinct().join(symbols.select("symbol_id"), "symbol_id", "left_anti")
    return made.groupBy("symbol_id").agg(F.count("*").alias("origins")).withColumn("kind", F.substring_index("symbol_id", ":", 1))
