"""The stored property graph: upserts, deletes, lookups, pruning and counts, all as DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.schema import SEMANTIC_KINDS


def current_nodes(nodes: DataFrame, version: str = "ingested_at") -> DataFrame:
    """Upsert by qualified_name: the row with the latest version wins, all its columns are kept; null keys are left out.

    max_by over a struct combines before the shuffle, so a key written very often is no hot spot.
    """
    columns = [c for c in nodes.columns if c != "qualified_name"]
    rows = nodes.where(F.col("qualified_name").isNotNull()).groupBy("qualified_name").agg(F.max_by(F.struct(*columns), F.struct(F.col(version).isNotNull(), version, F.to_json(F.struct(*columns)))).alias("v"))
    return rows.select("qualified_name", "v.*").select(*nodes.columns)


def current_edges(edges: DataFrame) -> DataFrame:
    """The edge multiset: redelivered rows of one edge_id and file count once, edges without both ends are left out."""
    filled = (F.col("source") != "") & (F.col("target") != "")
    # ids hold a hash of the file's path, so that only within one file they are sure to differ
    keys = [c for c in ("edge_id", "file_path") if c in edges.columns]
    columns = [c for c in edges.columns if c not in keys]
    return edges.where(filled).groupBy(*keys).agg(F.min(F.struct(*columns)).alias("v")).select(*keys, "v.*").select(*edges.columns)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new put in, last writer wins; of several new rows of one key the greatest counts."""
    fresh = new.groupBy("qualified_name").agg(F.max(F.struct(*[c for c in new.columns if c != "qualified_name"])).alias("v")).select("qualified_name", "v.*").select(*new.columns)
    return old.join(fresh.select("qualified_name"), "qualified_name", "left_anti").unionByName(fresh, allowMissingColumns=True)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def delete_files_narrow(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes and edges recorded in the files; edges of other files that point into them stay."""
    gone = files.select("file_path").distinct()
    return nodes.join(gone, "file_path", "left_anti"), edges.join(gone, "file_path", "left_anti")


def delete_files_wide(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the files' nodes, every edge that touches one of these or is recorded in the files, and every equal edge elsewhere."""
    gone = files.select("file_path").distinct()
    dead = nodes.join(gone, "file_path", "left_semi").select("qualified_name").distinct()
    key = ["kind", "source", "target"]
    stale = (
        edges.join(dead, edges["source"] == dead["qualified_name"], "left_semi").select(*key)
        .union(edges.join(dead, edges["target"] == dead["qualified_name"], "left_semi").select(*key))
        .union(edges.join(gone, "file_path", "left_semi").select(*key)).distinct()
    )
    return nodes.join(gone, "file_path", "left_anti"), edges.join(stale, key, "left_anti")


def clear(df: DataFrame) -> DataFrame:
    return df.limit(0)


# --- lookups -----------------------------------------------------------------------------------------------------------------


def by_key(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("qualified_name") == name)


def by(df: DataFrame, column: str, values: str | Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin([values] if isinstance(values, str) else list(values)))


def find(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes whose key or bare name it is; ``exact`` tells which, exact matches come first."""
    rows = nodes.where((F.col("qualified_name") == name) | (F.col("name") == name))
    return rows.withColumn("exact", F.col("qualified_name") == name).orderBy(F.desc("exact"), "qualified_name")


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def search_symbols(symbols: DataFrame, text: str, exact: bool = False) -> DataFrame:
    """Symbols by display name: equal to the text, or beginning with it, or with a dotted part of the key beginning so (any case)."""
    if exact:
        return symbols.where(F.col("display_name") == text)
    literal = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return symbols.where(F.col("display_name").ilike(f"{literal}%") | F.col("qualified_name").ilike(f"%.{literal}%"))


def incident(edges: DataFrame, names: DataFrame, direction: str = "outbound") -> DataFrame:
    """The edges that leave (outbound) or enter (inbound) any of the names; names: (qualified_name)."""
    end = "source" if direction == "outbound" else "target"
    return edges.join(names.select(F.col("qualified_name").alias(end)).distinct(), end, "left_semi")


def put_symbols(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of symbols; a missing display name becomes the key's last part."""
    return upsert(stored, new.withColumn("display_name", F.coalesce(F.nullif("display_name", F.lit("")), short_name(F.col("qualified_name")))))


def stale_symbols(stored: DataFrame, files: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The stored symbols of files that are gone or whose mtime (seconds) differs by more than the tolerance; files: (file_path, mtime)."""
    now = files.groupBy("file_path").agg(F.max("mtime").alias("now"))
    fresh = F.abs(F.col("mtime") - F.col("now")) <= tolerance
    return stored.join(now, "file_path", "left").where(~F.coalesce(fresh, F.lit(False))).select(*stored.columns)


CARD_SIDES = (("callers", "target", "source", ("CALLS",)), ("callees", "source", "target", ("CALLS",)), ("references", "target", "source", ("REFERENCES", "USES", "READS", "WRITES")))


def symbol_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(qualified_name, side, other), distinct: all callers, callees and references of the nodes, as rows, however hot a symbol is."""
    ends = [edges.where(F.col("kind").isin(list(kinds))).select(F.col(mine).alias("qualified_name"), F.lit(name).alias("side"), F.col(other).alias("other")) for name, mine, other, kinds in CARD_SIDES]
    rows = ends[0].unionByName(ends[1]).unionByName(ends[2]).where(F.col("other").isNotNull()).distinct()
    return rows.join(nodes.select("qualified_name").distinct(), "qualified_name", "left_semi")


def symbol_card(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(qualified_name, kind, parent, callers, callees, references): the names of each side as whole sorted lists.

    The list of a hot symbol is as long as its edges; ``symbol_links`` gives the same as rows.
    """
    lists = [F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col("other")))).alias(name) for name, *_ in CARD_SIDES]
    sides = symbol_links(nodes, edges).groupBy("qualified_name").agg(*lists)
    empty = F.expr("cast(array() as array<string>)")
    out = nodes.select("qualified_name", "kind", F.col("parent_qualified").alias("parent")).join(sides, "qualified_name", "left")
    return out.select("qualified_name", "kind", "parent", *[F.coalesce(name, empty).alias(name) for name, *_ in CARD_SIDES])


def relations(edges: DataFrame, kind: str, mine: str = "target", other: str = "source") -> DataFrame:
    """(name, other), distinct: callers (CALLS), subclasses (INHERITS), imports (IMPORTS_FROM, source to target) and the like."""
    return edges.where(F.col("kind") == kind).select(F.col(mine).alias("name"), F.col(other).alias("other")).distinct()


def reference_files(occurrences: DataFrame) -> DataFrame:
    """(symbol, file_path): the files that refer to a symbol."""
    return occurrences.where(F.col("role") == "reference").select("symbol", "file_path").distinct()


# --- pruning and counts ------------------------------------------------------------------------------------------------------


def prune(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = SEMANTIC_KINDS) -> tuple[DataFrame, DataFrame]:
    """Nodes of the kinds, and the first edge of each (kind, source, target) between two of them."""
    kept = nodes.where(F.col("kind").isin(list(kinds)))
    ends = kept.select("qualified_name").distinct()
    inner = between(edges, ends)
    columns = [c for c in edges.columns if c not in ("kind", "source", "target", "edge_id")]
    first = inner.groupBy("kind", "source", "target").agg(F.min(F.struct("edge_id", *columns)).alias("v"))
    return kept, first.select("kind", "source", "target", "v.*").select(*edges.columns)


def between(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The edges of which both ends are among the names; names: (qualified_name), distinct."""
    s, t = (names.select(F.col("qualified_name").alias(e)) for e in ("source", "target"))
    return edges.join(s, "source", "left_semi").join(t, "target", "left_semi")


def reduction(nodes: DataFrame, edges: DataFrame, kept_nodes: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """One row: counts before and after pruning and how much was taken off in percent."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    row = count(nodes, "nodes_before").crossJoin(count(edges, "edges_before")).crossJoin(count(kept_nodes, "nodes_after")).crossJoin(count(kept_edges, "edges_after"))
    off = lambda a, b: F.when(F.col(a) > 0, F.round((1 - F.col(b) / F.col(a)) * 100, 1)).otherwise(0.0)
    return row.withColumn("nodes_off", off("nodes_before", "nodes_after")).withColumn("edges_off", off("edges_before", "edges_after"))


def degrees(edges: DataFrame) -> DataFrame:
    """(qualified_name, fan_in, fan_out), parallel edges counted, for every name that an edge mentions."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("target").alias("qualified_name"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("qualified_name"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.qualified_name").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def breakdown(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, edges, density, average_degree) per edge kind."""
    n = nodes.agg(F.count("*").alias("n"))
    counts = edges.groupBy("kind").agg(F.count("*").alias("edges"))
    size = F.col("n").cast("double")
    density = F.when(size > 1, F.round(F.col("edges") / (size * (size - 1)), 9)).otherwise(0.0)
    return counts.crossJoin(F.broadcast(n)).select("kind", "edges", density.alias("density"), F.round(F.col("edges") / size, 6).alias("average_degree"))


def stale_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file_path, state) with state new, removed or changed; both: (file_path, mtime_ns, size), one row per path."""
    a = before.select(F.col("file_path").alias("path"), F.struct("mtime_ns", "size").alias("was"))
    b = now.select("file_path", F.struct("mtime_ns", "size").alias("be"))
    both = a.join(b, F.col("path") == F.col("file_path"), "full_outer")
    state = F.when(F.col("path").isNull(), "new").when(F.col("file_path").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("be")), "changed")
    return both.select(F.coalesce("file_path", "path").alias("file_path"), state.alias("state")).where(F.col("state").isNotNull())


# --- name resolution ---------------------------------------------------------------------------------------------------------


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, context): names that CALLS edges point to and no node has, with the file of the first such edge."""
    calls = edges.where(F.col("kind") == "CALLS").groupBy("target").agg(F.min_by("file_path", "edge_id").alias("context"))
    return calls.join(nodes.select(F.col("qualified_name").alias("target")).distinct(), "target", "left_anti")


# Which kinds a name more likely means, the likeliest first.
KIND_PREFERENCE = ("Function", "Method", "Class", "Interface", "Struct", "Enum", "Type", "Test", "Module", "Variable", "Constant")


def resolve(wanted: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(name, context, resolved, rule): names as seen in a file, resolved to symbols by the first rule that fits.

    Rules: exact key; the only symbol of that short name; same file; file of an imported module; preferred kind; among equals the
    preferred kind, then the least name. wanted: (name, context), imports: (file_path, module_path). Names that nothing fits are left
    out.
    """
    asked = wanted.select("name", "context", short_name(F.col("name")).alias("s")).distinct()
    place = F.array_position(F.array(*[F.lit(k) for k in KIND_PREFERENCE]), F.col("kind"))
    preference = F.when(F.coalesce(place, F.lit(0)) == 0, 99).otherwise(place)
    known = symbols.where(F.col("qualified_name").isNotNull()).select("qualified_name", preference.alias("preference"), F.col("file_path").alias("at"), "module_path", F.coalesce("display_name", short_name(F.col("qualified_name"))).alias("s")).dropDuplicates(["qualified_name"])
    # one best symbol a short name, and a file or module, so that a common name doesn't multiply callers by homonyms
    best = F.min(F.struct("preference", "qualified_name"))["qualified_name"]
    by_name = known.groupBy("s").agg(best.alias("preferred"), F.count("*").alias("n"))
    by_file = known.where(F.col("at").isNotNull()).groupBy("s", F.col("at").alias("context")).agg(best.alias("same_file"))
    rows = asked.join(known.select(F.col("qualified_name").alias("name")).withColumn("exact", F.col("name")), "name", "left").join(by_name, "s", "left").join(by_file, ["s", "context"], "left")
    if imports is None:
        rows = rows.withColumn("imported", F.lit(None).cast("string"))
    else:
        by_module = known.groupBy("s", "module_path").agg(F.min(F.struct("preference", "qualified_name")).alias("of"))
        via = imports.select(F.col("file_path").alias("context"), "module_path").distinct()
        found = asked.join(via, "context").join(by_module, ["s", "module_path"]).groupBy("name", "context").agg(F.min("of")["qualified_name"].alias("imported"))
        rows = rows.join(found, ["name", "context"], "left")
    only = F.when(F.col("n") == 1, F.col("preferred"))
    rule = F.when(F.col("exact").isNotNull(), "exact").when(only.isNotNull(), "unique").when(F.col("same_file").isNotNull(), "same_file").when(F.col("imported").isNotNull(), "imported").otherwise("preferred")
    resolved = F.coalesce("exact", only, "same_file", "imported", "preferred")
    return rows.select("name", "context", resolved.alias("resolved"), rule.alias("rule")).where(F.col("resolved").isNotNull())


def enrich(edges: DataFrame, nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """The edges with the targets of CALLS that name no node replaced by what they resolve to; the number of edges stays."""
    missing = unresolved(edges, nodes)
    found = resolve(missing.select(F.col("target").alias("name"), "context"), symbols).select(F.col("name").alias("target"), "resolved")
    calls = edges.where(F.col("kind") == "CALLS").join(found, "target", "left").withColumn("target", F.coalesce("resolved", "target")).select(*edges.columns)
    return edges.where((F.col("kind") != "CALLS") | F.col("kind").isNull()).unionByName(calls)


def module_symbols(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, qualified_name): symbols of files whose dotted path is the module or ends with it.

    Every file offers all suffixes of its dotted path as keys, so this is an equi-join instead of a comparison of all with all.
    """
    dotted = F.regexp_replace(F.regexp_replace("file_path", r"\.[A-Za-z0-9]+$", ""), r"[/\\]", ".")
    parts = F.split(dotted, r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    offered = symbols.where(F.col("file_path").isNotNull()).select("qualified_name", F.explode(keys).alias("module"))
    return offered.join(modules.select("module").distinct(), "module").select("module", "qualified_name").distinct()


def test_subjects(nodes: DataFrame) -> DataFrame:
    """(source, target, file_path): tests and the function or method of the same file that their name stands for."""
    tests = nodes.where(F.col("kind") == "Test").select(F.col("qualified_name").alias("source"), "file_path", F.explode(F.array(F.regexp_extract("name", r"^test_(.+)$", 1), F.regexp_extract("name", r"^test(.+)$", 1))).alias("subject")).where("subject <> ''")
    subjects = nodes.where(F.col("kind").isin("Function", "Method")).select(F.col("qualified_name").alias("target"), F.col("file_path").alias("f"), F.col("name").alias("subject"))
    rows = tests.join(subjects, (F.col("file_path") == F.col("f")) & (tests["subject"] == subjects["subject"]))
    return rows.groupBy("source", "file_path").agg(F.min("target").alias("target")).select("source", "target", "file_path")
