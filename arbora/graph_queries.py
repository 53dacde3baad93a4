"""Queries of the graph operators over the whole nodes, edges, symbols and vectors tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions import vectors as V
from arbora.operators import clusters as C
from arbora.operators import embedding as E
from arbora.operators import export as X
from arbora.operators import graph as G
from arbora.operators import ranking as R
from arbora.operators import retrieval as Q
from arbora.operators import traversal as T
from arbora.plans.optimizer import TraversalPlan, optimize
from arbora.sources import ingest, walk
from arbora.schema import COMMUNITY_WEIGHTS, IMPACT_EDGES, OTHER_WEIGHT, RANKED_EDGES, SEMANTIC_KINDS, SKIPPED_FOR_EMBEDDING, TAINT_EDGES, WEIGHTS
from arbora.functions.words import LABEL_STOP, LEXICAL_STOP
from arbora.streaming.refresh import windowed_counts
from arbora.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _WITH + sql
        return f

    return register


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.current_nodes(table(spark, d, "nodes"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.current_edges(table(spark, d, "edges"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the columns that walks need, held for the walk's many passes; lost parts are computed again."""
    nodes = _nodes(spark, d).select("qualified_name", "kind", "name", "file_path")
    edges = _edges(spark, d).select("edge_id", "kind", "source", "target")
    return nodes.persist(StorageLevel.MEMORY_AND_DISK), edges.persist(StorageLevel.MEMORY_AND_DISK)


def _hub(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node with the most callers, ties by name: a start that every input has."""
    called = edges.where(F.col("kind") == "CALLS").groupBy(F.col("target").alias("qualified_name")).agg(F.count("*").alias("n"))
    return called.join(nodes.select("qualified_name"), "qualified_name", "left_semi").orderBy(F.desc("n"), "qualified_name").limit(1).select("qualified_name")


def _members(spark: SparkSession, d: str) -> DataFrame:
    return C.stored_members(table(spark, d, "cluster_members"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vectors").where(V.usable(F.col("vector"), 64))
    return rows.groupBy("qualified_name").agg(F.min("vector").alias("vector"))


_WITH = """WITH RECURSIVE n AS MATERIALIZED (
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY ingested_at DESC NULLS LAST, deleted_at DESC NULLS LAST) AS r FROM nodes WHERE qualified_name IS NOT NULL) WHERE r = 1),
e AS MATERIALIZED (SELECT DISTINCT ON (edge_id) * FROM edges WHERE source <> '' AND target <> ''),
hub AS MATERIALIZED (SELECT target AS h FROM e WHERE kind = 'CALLS' AND target IN (SELECT qualified_name FROM n) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
m AS (SELECT qualified_name, min(cluster_id) AS cluster_id FROM cluster_members WHERE qualified_name IS NOT NULL GROUP BY 1),
v AS (SELECT qualified_name, min(vector) AS vector FROM vectors WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY 1)
"""

# --- stores, lookups, counts -------------------------------------------------------------------------------------------------


@query("SELECT qualified_name, kind, name, file_path, language, parent_qualified FROM n")
def nodes_upsert(spark, d):
    return _nodes(spark, d).select("qualified_name", "kind", "name", "file_path", "language", "parent_qualified")


@query("SELECT kind, count(*) AS edges, round(count(*) / (any_value(c)::DOUBLE * (any_value(c) - 1)), 9) AS density, round(count(*) / any_value(c)::DOUBLE, 6) AS average_degree FROM e, (SELECT count(*) AS c FROM n) GROUP BY kind")
def edge_breakdown(spark, d):
    return G.breakdown(_nodes(spark, d), _edges(spark, d))


@query("SELECT kind, language, count(*) AS nodes, count(DISTINCT file_path) AS files FROM n GROUP BY ALL")
def nodes_by_kind(spark, d):
    return _nodes(spark, d).groupBy("kind", "language").agg(F.count("*").alias("nodes"), F.count_distinct("file_path").alias("files"))


@query("""SELECT q AS qualified_name, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT target AS q, 1 AS i, 0 AS o FROM e UNION ALL SELECT source, 0, 1 FROM e) GROUP BY 1""")
def node_degrees(spark, d):
    return G.degrees(_edges(spark, d))


@query("SELECT DISTINCT target AS name, source AS other FROM e WHERE kind = 'CALLS'")
def callers(spark, d):
    return G.relations(_edges(spark, d), "CALLS")


@query("SELECT DISTINCT source AS name, target AS other FROM e WHERE kind = 'CALLS'")
def callees(spark, d):
    return G.relations(_edges(spark, d), "CALLS", "source", "target")


@query("SELECT DISTINCT source AS name, target AS other FROM e WHERE kind = 'IMPORTS_FROM'")
def imports(spark, d):
    return G.relations(_edges(spark, d), "IMPORTS_FROM", "source", "target")


@query("SELECT DISTINCT target AS name, source AS other FROM e WHERE kind = 'INHERITS'")
def subclasses(spark, d):
    return G.relations(_edges(spark, d), "INHERITS")


@query("SELECT file_path, count(*) AS symbols, count(DISTINCT name) AS names FROM n WHERE kind <> 'File' GROUP BY 1")
def symbols_in_file(spark, d):
    return _nodes(spark, d).where(F.col("kind") != "File").groupBy("file_path").agg(F.count("*").alias("symbols"), F.count_distinct("name").alias("names"))


@query("""SELECT n.qualified_name, n.kind, n.parent_qualified AS parent, coalesce(a.l, []) AS callers, coalesce(b.l, []) AS callees, coalesce(c.l, []) AS "references" FROM n
  LEFT JOIN (SELECT target AS q, list_sort(list(DISTINCT source)) AS l FROM e WHERE kind = 'CALLS' GROUP BY 1) a ON a.q = n.qualified_name
  LEFT JOIN (SELECT source AS q, list_sort(list(DISTINCT target)) AS l FROM e WHERE kind = 'CALLS' GROUP BY 1) b ON b.q = n.qualified_name
  LEFT JOIN (SELECT target AS q, list_sort(list(DISTINCT source)) AS l FROM e WHERE kind IN ('REFERENCES', 'USES', 'READS', 'WRITES') GROUP BY 1) c ON c.q = n.qualified_name""")
def symbol_cards(spark, d):
    return G.symbol_card(_nodes(spark, d), _edges(spark, d))


@query("""SELECT * FROM (SELECT target AS qualified_name, 'callers' AS side, source AS other FROM e WHERE kind = 'CALLS' UNION SELECT source, 'callees', target FROM e WHERE kind = 'CALLS'
  UNION SELECT target, 'references', source FROM e WHERE kind IN ('REFERENCES', 'USES', 'READS', 'WRITES')) WHERE other IS NOT NULL AND qualified_name IN (SELECT qualified_name FROM n)""")
def symbol_links(spark, d):
    return G.symbol_links(_nodes(spark, d), _edges(spark, d))


@query("""SELECT DISTINCT qualified_name, display_name FROM symbols WHERE display_name ILIKE 'merge%' OR qualified_name ILIKE '%.merge%'""")
def symbol_search(spark, d):
    return G.search_symbols(table(spark, d, "symbols"), "merge").select("qualified_name", "display_name").distinct()


@query("""SELECT n.qualified_name, n.qualified_name = x.name AS exact FROM n, (SELECT name FROM n WHERE name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) x WHERE n.qualified_name = x.name OR n.name = x.name""")
def find_nodes(spark, d):
    """All nodes of the most common name."""
    nodes = _nodes(spark, d)
    most = nodes.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "name").first()
    return G.find(nodes, most[0] if most else "").select("qualified_name", "exact")


@query(f"""SELECT kind, source, target, min(edge_id) AS edge_id FROM e WHERE source IN (SELECT qualified_name FROM n WHERE kind IN ({_list(SEMANTIC_KINDS)})) AND target IN (SELECT qualified_name FROM n WHERE kind IN ({_list(SEMANTIC_KINDS)})) GROUP BY 1, 2, 3""")
def pruned_edges(spark, d):
    return G.prune(_nodes(spark, d), _edges(spark, d))[1].select("kind", "source", "target", "edge_id")


@query(f"""SELECT a AS nodes_before, b AS edges_before, c AS nodes_after, x AS edges_after, round((1 - c / a) * 100, 1) AS nodes_off, round((1 - x / b) * 100, 1) AS edges_off FROM
  (SELECT count(*) AS a, count(*) FILTER (kind IN ({_list(SEMANTIC_KINDS)})) AS c FROM n), (SELECT count(*) AS b FROM e),
  (SELECT count(DISTINCT (kind, source, target)) AS x FROM e WHERE source IN (SELECT qualified_name FROM n WHERE kind IN ({_list(SEMANTIC_KINDS)})) AND target IN (SELECT qualified_name FROM n WHERE kind IN ({_list(SEMANTIC_KINDS)})))""")
def prune_reduction(spark, d):
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    return G.reduction(nodes, edges, *G.prune(nodes, edges))


_RUNS = """runs AS (SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS r FROM (SELECT DISTINCT f.run_id FROM files f JOIN index_runs i ON i.run_id = f.run_id AND i.status = 'ok')),
a AS (SELECT file_path, max(mtime_ns) AS t, max(size) AS s FROM files WHERE run_id = (SELECT run_id FROM runs WHERE r = 2) GROUP BY 1), b AS (SELECT file_path, max(mtime_ns) AS t, max(size) AS s FROM files WHERE run_id = (SELECT run_id FROM runs WHERE r = 1) GROUP BY 1)"""


@query(f""", {_RUNS} SELECT coalesce(b.file_path, a.file_path) AS file_path, CASE WHEN a.file_path IS NULL THEN 'new' WHEN b.file_path IS NULL THEN 'removed' ELSE 'changed' END AS state
  FROM a FULL JOIN b ON a.file_path = b.file_path WHERE a.file_path IS NULL OR b.file_path IS NULL OR a.t <> b.t OR a.s <> b.s""")
def stale_files(spark, d):
    """Files that differ between the last two successful runs that noted any."""
    files, runs = table(spark, d, "files"), table(spark, d, "index_runs")
    noted = files.join(runs.where("status = 'ok'").select("run_id"), "run_id", "left_semi").select("run_id").distinct().orderBy(F.desc("run_id")).limit(2).collect()
    ids = [r[0] for r in noted] + [-1, -1]
    at = lambda run: files.where(F.col("run_id") == run).groupBy("file_path").agg(F.max("mtime_ns").alias("mtime_ns"), F.max("size").alias("size"))
    return G.stale_files(at(ids[1]), at(ids[0]))


@query("""SELECT count(*) AS nodes, (SELECT count(*) FROM e WHERE file_path NOT IN (SELECT DISTINCT file_path FROM files WHERE size % 7 = 0) OR file_path IS NULL) AS edges FROM n WHERE file_path NOT IN (SELECT DISTINCT file_path FROM files WHERE size % 7 = 0) OR file_path IS NULL""")
def delete_narrow(spark, d):
    gone = table(spark, d, "files").where("size % 7 = 0").select("file_path")
    nodes, edges = G.delete_files_narrow(_nodes(spark, d), _edges(spark, d), gone)
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


@query(""", g AS (SELECT DISTINCT file_path FROM files WHERE size % 7 = 0), dead AS (SELECT qualified_name AS q FROM n WHERE file_path IN (FROM g)),
  stale AS (SELECT DISTINCT kind, source, target FROM e WHERE source IN (FROM dead) OR target IN (FROM dead) OR file_path IN (FROM g))
  SELECT (SELECT count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.file_path = n.file_path)) AS nodes, (SELECT count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM stale s WHERE s.kind = e.kind AND s.source = e.source AND s.target = e.target)) AS edges""")
def delete_wide(spark, d):
    gone = table(spark, d, "files").where("size % 7 = 0").select("file_path")
    nodes, edges = G.delete_files_wide(_nodes(spark, d), _edges(spark, d), gone)
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


@query("""SELECT target, arg_min(file_path, edge_id) AS context FROM e WHERE kind = 'CALLS' AND target NOT IN (SELECT qualified_name FROM n) GROUP BY 1""")
def unresolved_calls(spark, d):
    return G.unresolved(_edges(spark, d), _nodes(spark, d))


@query("""SELECT s.qualified_name AS name, count(DISTINCT t.qualified_name) AS homonyms FROM (SELECT DISTINCT qualified_name, regexp_extract(qualified_name, '[^.]*$') AS s FROM symbols WHERE qualified_name IS NOT NULL) s
  JOIN (SELECT DISTINCT qualified_name, coalesce(display_name, regexp_extract(qualified_name, '[^.]*$')) AS x FROM symbols) t ON t.x = s.s GROUP BY 1""")
def symbol_homonyms(spark, d):
    symbols = table(spark, d, "symbols").where(F.col("qualified_name").isNotNull())
    short = G.short_name(F.col("qualified_name"))
    counts = symbols.groupBy(F.coalesce("display_name", short).alias("x")).agg(F.count_distinct("qualified_name").alias("homonyms"))
    return symbols.select(F.col("qualified_name").alias("name"), short.alias("x")).distinct().join(counts, "x").select("name", "homonyms")


_RESOLVED = f"""sy AS (SELECT DISTINCT ON (qualified_name) qualified_name AS k, kind, file_path AS fp, coalesce(display_name, regexp_extract(qualified_name, '[^.]*$')) AS short FROM symbols WHERE qualified_name IS NOT NULL),
asked AS (SELECT target AS name, arg_min(file_path, edge_id) AS context FROM e WHERE kind = 'CALLS' AND target NOT IN (SELECT qualified_name FROM n) GROUP BY 1),
fits AS (SELECT name, context, k, 0 AS level, kind, fp FROM asked JOIN sy ON sy.k = name UNION ALL SELECT name, context, k, 1, kind, fp FROM asked JOIN sy ON sy.short = regexp_extract(name, '[^.]*$')),
ordered AS (SELECT *, NOT coalesce(fp = context, false) AS other, row_number() OVER (PARTITION BY name, context ORDER BY level, NOT coalesce(fp = context, false), CASE WHEN coalesce(list_position([{_list(G.KIND_PREFERENCE)}], kind), 0) = 0 THEN 99 ELSE list_position([{_list(G.KIND_PREFERENCE)}], kind) END, k) AS r FROM fits),
rs AS MATERIALIZED (SELECT o.name, o.context, o.k AS resolved, CASE WHEN o.level = 0 THEN 'exact' WHEN c.n = 1 THEN 'unique' WHEN NOT o.other THEN 'same_file' ELSE 'preferred' END AS rule
  FROM ordered o JOIN (SELECT name, context, count(DISTINCT k) AS n FROM fits GROUP BY 1, 2) c ON c.name = o.name AND c.context IS NOT DISTINCT FROM o.context WHERE o.r = 1)"""


@query(f", {_RESOLVED} SELECT name, context, resolved, rule FROM rs")
def resolved_calls(spark, d):
    missing = G.unresolved(_edges(spark, d), _nodes(spark, d))
    return G.resolve(missing.select(F.col("target").alias("name"), "context"), table(spark, d, "symbols"))


@query(f", {_RESOLVED} SELECT e.kind, coalesce(rs.resolved, e.target) AS target, count(*) AS edges FROM e LEFT JOIN rs ON e.kind = 'CALLS' AND rs.name = e.target GROUP BY 1, 2")
def enriched_edges(spark, d):
    """Edges by kind and the target they have once calls are resolved."""
    return G.enrich(_edges(spark, d), _nodes(spark, d), table(spark, d, "symbols")).groupBy("kind", "target").agg(F.count("*").alias("edges"))


@query(""", t AS (SELECT qualified_name AS source, file_path, unnest([regexp_extract(name, '^test_(.+)$', 1), regexp_extract(name, '^test(.+)$', 1)]) AS subject FROM n WHERE kind = 'Test')
  SELECT t.source, min(s.qualified_name) AS target, t.file_path FROM t JOIN n s ON s.file_path = t.file_path AND s.name = t.subject AND s.kind IN ('Function', 'Method') WHERE t.subject <> '' GROUP BY 1, 3""")
def test_subjects(spark, d):
    return G.test_subjects(_nodes(spark, d))


# --- traversal ---------------------------------------------------------------------------------------------------------------


def _walk(direction: str, kinds, depth: int, start: str, known: bool = True) -> str:
    a, b = ("source", "target") if direction == "outbound" else ("target", "source")
    only = f"AND e.kind IN ({_list(kinds)})" if kinds else ""
    node = f"AND e.{b} IN (SELECT qualified_name FROM n)" if known else ""
    return f""", w AS ({start} UNION SELECT e.{b}, w.depth + 1 FROM w JOIN e ON e.{a} = w.q WHERE w.depth < {depth} {only} {node})"""


@query(_walk("outbound", None, 3, "SELECT qualified_name AS q, 0 AS depth FROM n WHERE kind = 'Module'") + " SELECT q AS qualified_name, min(depth)::INT AS depth FROM w GROUP BY 1")
def impact_radius(spark, d):
    """Least outbound depth of every node from any module, up to 3."""
    nodes, edges = _graph(spark, d)
    return T.depths(edges, nodes.where(F.col("kind") == "Module"), 3, nodes=nodes)


def _first(seeds: str, depth: int, limit: int) -> str:
    """The nodes found from the seeds in the order of a breadth-first walk, each by its first path."""
    return f""", bw AS (SELECT q, 0 AS depth, [q] AS path, []::VARCHAR[] AS kinds, [('0x' || substr(md5(q), 1, 15))::BIGINT] AS visit FROM ({seeds}) WHERE q IN (SELECT qualified_name FROM n)
  UNION ALL SELECT e.target, depth + 1, list_append(path, e.target), list_append(kinds, e.kind), list_append(visit, e.edge_id) FROM bw JOIN e ON e.source = bw.q WHERE depth < {depth} AND e.target IN (SELECT qualified_name FROM n)),
  bf AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY depth, visit) AS r FROM bw) WHERE r = 1 ORDER BY depth, visit LIMIT {limit})"""


@query(_first("SELECT h AS q FROM hub", 3, 10_000) + " SELECT q AS qualified_name, depth::INT AS depth, array_to_string(path, ' > ') AS path, array_to_string(kinds, ' > ') AS edge_kinds, row_number() OVER (ORDER BY depth, visit) AS place FROM bf")
def bfs_hub(spark, d):
    """What a walk from the hub finds, with the paths and in the order it finds them."""
    nodes, edges = _graph(spark, d)
    found = T.bfs(nodes, edges, _hub(edges, nodes), TraversalPlan(max_depth=3, max_nodes=10_000))
    order = Window.partitionBy(F.lit("all")).orderBy("depth", "visit")  # at most 10,000 rows
    return found.select("qualified_name", "depth", F.array_join("path", " > ").alias("path"), F.array_join("edge_kinds", " > ").alias("edge_kinds"), F.row_number().over(order).cast("long").alias("place"))


@query(_walk("inbound", IMPACT_EDGES, 4, "SELECT h AS q, 0 AS depth FROM hub") + f"""
  SELECT (SELECT count(DISTINCT source) FROM e WHERE target = (SELECT h FROM hub) AND kind IN ({_list(IMPACT_EDGES)})) AS direct_callers, count(*) AS transitive, count(DISTINCT n.file_path) AS files, count(*) FILTER (n.kind = 'Test') AS tests, max(r.depth)::INT AS deepest
  FROM (SELECT q, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0 ORDER BY 2, 1) r JOIN n ON n.qualified_name = r.q""")
def impact_of_hub(spark, d):
    nodes, edges = _graph(spark, d)
    return Q.impact_summary(Q.impact(nodes, edges, _hub(edges, nodes)))


@query(f""", t AS (SELECT qualified_name AS s, qualified_name AS q, 0 AS depth FROM n WHERE kind = 'Test' UNION SELECT t.s, e.target, t.depth + 1 FROM t JOIN e ON e.source = t.q AND e.kind IN ({_list(TAINT_EDGES)}) WHERE t.depth < 4)
  SELECT s AS source, q AS sink, min(depth)::INT AS depth FROM t WHERE q IN (SELECT qualified_name FROM n WHERE kind = 'Class') GROUP BY 1, 2 HAVING min(depth) > 0""")
def taint_flows(spark, d):
    nodes, edges = _graph(spark, d)
    flows = T.taint(edges, nodes.where(F.col("kind") == "Test"), nodes.where(F.col("kind") == "Class"), 4)
    return flows.select("source", "sink", "depth")


@query(_walk("outbound", ["CALLS"], 2, "SELECT qualified_name AS q, 0 AS depth FROM n WHERE kind = 'Class'", known=False) + " SELECT count(DISTINCT q) AS nodes FROM w")
def size_estimate(spark, d):
    return T.size_estimate(_edges(spark, d), _nodes(spark, d).where(F.col("kind") == "Class"), ["CALLS"])


@query(_walk("outbound", None, 12, "SELECT h AS q, 0 AS depth FROM hub", known=False) + " SELECT (max(x) + 1)::INT AS hops FROM (SELECT q, min(depth) AS x FROM w GROUP BY 1)")
def shortest_path_hops(spark, d):
    """Nodes on the shortest path from the hub to the farthest name, the least of those equally far."""
    nodes, edges = _graph(spark, d)
    hub = _hub(edges, nodes).first()[0]
    far = T.depths(edges, spark.createDataFrame([(hub,)], "qualified_name string"), 12).orderBy(F.desc("depth"), "qualified_name").first()[0]
    return T.shortest_path(edges, hub, far).select(F.size("path").alias("hops"))


@query()
def dfs_hub(spark, d):
    nodes, edges = _graph(spark, d)
    return T.dfs(nodes, edges, _hub(edges, nodes), TraversalPlan(max_depth=3)).drop("cost")


@query()
def weighted_bfs_hub(spark, d):
    nodes, edges = _graph(spark, d)
    return T.weighted_bfs(nodes, edges, _hub(edges, nodes), TraversalPlan(max_depth=3), {"CALLS": 1.0, "CONTAINS": 0.2})


@query()
def beam_hub(spark, d):
    nodes, edges = _graph(spark, d)
    degree = G.degrees(edges).select("qualified_name", (F.col("fan_in") / (F.col("fan_in") + F.col("fan_out") + 1)).alias("score"))
    return T.beam(nodes, edges, _hub(edges, nodes), degree)


@query("SELECT * FROM (VALUES ('impact', 8, 26, 'CALLS,DEPENDS_ON,IMPORTS_FROM'), ('callers', 5, 26, 'CALLS'), ('tests', 5, 26, 'TESTED_BY'), (NULL, 5, 5000, '')) t(intent, max_depth, max_nodes, kinds)")
def optimized_plans(spark, d):
    cases = [("impact", 12, 4000), ("callers", 5, 4000), ("tests", 5, 4000), (None, 5, None)]
    plans = [(i, optimize(TraversalPlan(max_depth=depth), tokens, i)) for i, depth, tokens in cases]
    return spark.createDataFrame([(i, p.max_depth, p.max_nodes, ",".join(p.edge_kinds or ())) for i, p in plans], "intent string, max_depth int, max_nodes int, kinds string")


# --- ranking -----------------------------------------------------------------------------------------------------------------

_RANKABLE = f"""rn AS MATERIALIZED (SELECT qualified_name AS q FROM n WHERE kind IN ({_list(SEMANTIC_KINDS)})),
l AS MATERIALIZED (SELECT source AS s, target AS t FROM e WHERE kind IN ({_list(RANKED_EDGES)}) AND source IN (FROM rn) AND target IN (FROM rn)),
outs AS MATERIALIZED (SELECT s, count(*) AS c FROM l GROUP BY 1), size AS MATERIALIZED (SELECT count(*)::DOUBLE AS c FROM rn)"""


def _unrolled(name: str, start: str, step: str, rounds: int) -> str:
    parts = [f"{name}0 AS MATERIALIZED ({start})"]
    parts += [f"{name}{i} AS MATERIALIZED ({step.replace('PREV', f'{name}{i - 1}')})" for i in range(1, rounds + 1)]
    return ", ".join(parts)


_PAGERANK = _unrolled(
    "r", "SELECT q, 1 / c AS v FROM rn, size",
    """SELECT rn.q, 0.15 / size.c + 0.85 * (coalesce(g.v, 0) + (SELECT coalesce(sum(v), 0) FROM PREV WHERE q NOT IN (SELECT s FROM outs)) / size.c) AS v
       FROM rn CROSS JOIN size LEFT JOIN (SELECT l.t, sum(p.v / outs.c) AS v FROM l JOIN PREV p ON p.q = l.s JOIN outs ON outs.s = l.s GROUP BY 1) g ON g.t = rn.q""", 10)  # fmt: skip
_EIGEN = _unrolled(
    "x", "SELECT q, 1 / c AS v FROM rn, size",
    "SELECT q, v / (SELECT sqrt(sum(v * v)) FROM (SELECT b AS q, sum(p.v * u.w) AS v FROM u JOIN PREV p ON p.q = u.a GROUP BY 1)) AS v FROM (SELECT b AS q, sum(p.v * u.w) AS v FROM u JOIN PREV p ON p.q = u.a GROUP BY 1)", 20)


@query(f", {_RANKABLE}, {_PAGERANK} SELECT q AS qualified_name, round(v, 9) AS score FROM r10")
def pagerank(spark, d):
    names, links = R.rankable(_nodes(spark, d), _edges(spark, d))
    return R.pagerank(names, links, rounds=10, tolerance=0.0).select("qualified_name", F.round("score", 9).alias("score"))


@query(f", {_RANKABLE}, u AS MATERIALIZED (SELECT s AS a, t AS b, count(*) AS w FROM (SELECT s, t FROM l UNION ALL SELECT t, s FROM l) GROUP BY 1, 2), {_EIGEN} SELECT rn.q AS qualified_name, round(coalesce(x20.v, 0) / (SELECT max(v) FROM x20), 6) AS score FROM rn LEFT JOIN x20 ON x20.q = rn.q")
def eigenvector(spark, d):
    names, links = R.rankable(_nodes(spark, d), _edges(spark, d))
    return R.eigenvector(names, links).select("qualified_name", F.round("score", 6).alias("score"))


@query()
def directed_eigenvector(spark, d):
    names, links = R.rankable(_nodes(spark, d), _edges(spark, d))
    return R.directed_eigenvector(names, links).withColumn("score", F.round("score", 6))


@query(f""", {_RANKABLE} SELECT q AS qualified_name, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out, round(ln(1 + coalesce(i.c, 0) * coalesce(o.c, 0)) / ln(1 + size.c), 9) AS score
  FROM rn CROSS JOIN size LEFT JOIN (SELECT t, count(*) AS c FROM l GROUP BY 1) i ON i.t = q LEFT JOIN outs o ON o.s = q""")
def bridge(spark, d):
    names, links = R.rankable(_nodes(spark, d), _edges(spark, d))
    return R.bridge(names, links).withColumn("score", F.round("score", 9))


@query(f""", {_RANKABLE}, src AS (SELECT q FROM rn ORDER BY md5(q), q LIMIT 100), c AS (SELECT q AS s, q, 0 AS depth FROM src UNION SELECT c.s, l.t, c.depth + 1 FROM c JOIN l ON l.s = c.q WHERE c.depth < 3)
  SELECT rn.q AS qualified_name, round(coalesce(1 / (1 + a.d), 0), 9) AS score FROM rn LEFT JOIN (SELECT q, avg(d) AS d FROM (SELECT s, q, min(depth) AS d FROM c GROUP BY 1, 2) WHERE d > 0 GROUP BY 1) a ON a.q = rn.q""")
def closeness(spark, d):
    names, links = R.rankable(_nodes(spark, d), _edges(spark, d))
    return R.closeness(names, links).withColumn("score", F.round("score", 9))


@query()
def betweenness(spark, d):
    names, links = R.rankable(_nodes(spark, d), _edges(spark, d))
    return R.betweenness(names, links).withColumn("score", F.round("score", 9))


_CENTRAL = f"""{_RANKABLE}, {_PAGERANK}, u AS MATERIALIZED (SELECT s AS a, t AS b, count(*) AS w FROM (SELECT s, t FROM l UNION ALL SELECT t, s FROM l) GROUP BY 1, 2), {_EIGEN},
src AS (SELECT q FROM rn ORDER BY md5(q), q LIMIT 100), c AS (SELECT q AS s, q, 0 AS depth FROM src UNION SELECT c.s, l.t, c.depth + 1 FROM c JOIN l ON l.s = c.q WHERE c.depth < 3),
near AS (SELECT q, 1 / (1 + avg(d)) AS v FROM (SELECT s, q, min(depth) AS d FROM c GROUP BY 1, 2) WHERE d > 0 GROUP BY 1),
deg AS (SELECT rn.q, coalesce(i.c, 0) AS fi, coalesce(o.c, 0) AS fo FROM rn LEFT JOIN (SELECT t, count(*) AS c FROM l GROUP BY 1) i ON i.t = q LEFT JOIN outs o ON o.s = q),
ms AS MATERIALIZED (SELECT deg.q, fi, fo, r10.v AS influence, ln(1 + fi * fo) / ln(1 + size.c) AS bridge, coalesce(near.v, 0) AS closeness, coalesce(x20.v, 0) / (SELECT max(v) FROM x20) AS eigenvector, fi / (SELECT max(fi) FROM deg) AS share
  FROM deg CROSS JOIN size JOIN r10 ON r10.q = deg.q LEFT JOIN near ON near.q = deg.q LEFT JOIN x20 ON x20.q = deg.q),
central AS MATERIALIZED (SELECT *, 0.40 * influence + 0.25 * bridge + 0.15 * closeness + 0.10 * eigenvector + 0.10 * share AS composite FROM ms)"""


@query(f""", {_CENTRAL} SELECT q AS qualified_name, fi AS fan_in, fo AS fan_out, round(influence, 6) AS influence, round(bridge, 6) AS bridge, round(closeness, 6) AS closeness, round(eigenvector, 6) AS eigenvector,
  round(fi / (fi + fo + 1), 6) AS stability, round(fo / (fi + fo + 1), 6) AS volatility, round(composite, 6) AS composite FROM central""")
def centrality(spark, d):
    scores = R.centrality(_nodes(spark, d), _edges(spark, d), rounds=10, tolerance=0.0)
    return scores.select("qualified_name", "fan_in", "fan_out", *[F.round(c, 6).alias(c) for c in ("influence", "bridge", "closeness", "eigenvector", "stability", "volatility", "composite")])


@query(f", {_CENTRAL} SELECT q AS qualified_name, round(composite, 6) AS composite FROM central ORDER BY central.composite DESC, q LIMIT 20")
def top_nodes(spark, d):
    return R.top(R.centrality(_nodes(spark, d), _edges(spark, d), rounds=10, tolerance=0.0), 20).select("qualified_name", F.round("composite", 6).alias("composite"))


def _case(weights: dict[str, float]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {OTHER_WEIGHT} END"


_PPR = _unrolled(
    "p", "SELECT qualified_name AS q, CASE WHEN qualified_name = (SELECT h FROM hub) THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM n",
    """SELECT q, v / sum(v) OVER () AS v FROM (SELECT n.qualified_name AS q, 0.15 * CASE WHEN n.qualified_name = (SELECT h FROM hub) THEN 1.0 ELSE 0.0 END::DOUBLE + 0.85 * (coalesce(g.v, 0) + (SELECT coalesce(sum(p.v), 0) FROM PREV p WHERE p.q NOT IN (SELECT s FROM sh)) / (SELECT count(*)::DOUBLE FROM n)) AS v
       FROM n LEFT JOIN (SELECT sh.t, sum(p.v * sh.w) AS v FROM sh JOIN PREV p ON p.q = sh.s GROUP BY 1) g ON g.t = n.qualified_name)""", 8)  # fmt: skip


_SHARES = f"""we AS MATERIALIZED (SELECT source AS s, target AS t, {_case(WEIGHTS)}::DOUBLE AS w FROM e), sh AS MATERIALIZED (SELECT s, t, w / total AS w FROM (SELECT s, t, sum(w) AS w FROM we GROUP BY 1, 2) JOIN (SELECT s, sum(w) AS total FROM we GROUP BY 1) USING (s)
  WHERE s IN (SELECT qualified_name FROM n) AND t IN (SELECT qualified_name FROM n))"""


@query(f""", {_SHARES}, {_PPR} SELECT q AS qualified_name, round(v, 8) AS score FROM p8""")
def personalised_rank(spark, d):
    nodes, edges = _graph(spark, d)
    return R.personalised(nodes, edges, _hub(edges, nodes), rounds=8, tolerance=0.0).withColumn("score", F.round("score", 8))


@query(f""", {_SHARES}, {_PPR}, hv AS (SELECT vector::DOUBLE[] AS b FROM v WHERE qualified_name = (SELECT h FROM hub)),
  fc AS (SELECT qualified_name AS q, greatest(round(list_cosine_similarity(vector::DOUBLE[], b), 9), 0) AS c FROM v, hv WHERE len(list_filter(vector, lambda x: x <> 0)) > 0),
  fj AS (SELECT p8.q, p8.v AS ppr, coalesce(fc.c, 0) AS semantic, coalesce(f.n, 0) AS n FROM p8 LEFT JOIN (SELECT target AS q, count(*) AS n FROM e GROUP BY 1) f ON f.q = p8.q LEFT JOIN fc ON fc.q = p8.q),
  fz AS (SELECT q, ppr, semantic, n / greatest((SELECT max(n) FROM fj), 1) AS structural FROM fj)
  SELECT q AS qualified_name, round(ppr, 6) AS ppr, round(semantic, 6) AS semantic, round(structural, 6) AS structural, round(0.5 * ppr + 0.3 * semantic + 0.2 * structural, 6) AS combined FROM fz ORDER BY round(0.5 * ppr + 0.3 * semantic + 0.2 * structural, 9) DESC, q LIMIT 50""")
def fused_rank(spark, d):
    nodes, edges = _graph(spark, d)
    hub = _hub(edges, nodes)
    ranked = R.personalised(nodes, edges, hub, rounds=8, tolerance=0.0)
    return R.fuse(ranked, edges, _cosines(spark, d, hub)).select("qualified_name", *[F.round(c, 6).alias(c) for c in ("ppr", "semantic", "structural", "combined")])


@query(f", {_RANKABLE}, {_PAGERANK} SELECT round(stddev_pop(v), 9) AS deviation, round(-sum(v * ln(v + 1e-15)), 6) AS entropy, round(max(v), 9) AS greatest, round(min(v), 9) AS least FROM r10")
def rank_discrimination(spark, d):
    names, links = R.rankable(_nodes(spark, d), _edges(spark, d))
    row = R.discrimination(R.pagerank(names, links, rounds=10, tolerance=0.0))
    return row.select(*[F.round(c, 6 if c == "entropy" else 9).alias(c) for c in row.columns])


# --- texts and vectors -------------------------------------------------------------------------------------------------------

_WORDS = lambda c: f"trim(lower(replace(replace(regexp_replace(regexp_replace({c}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '-', ' ')))"
_TEXT = f"""tx AS MATERIALIZED (SELECT qualified_name, concat_ws(' ', concat_ws(' ', CASE kind WHEN 'Endpoint' THEN 'api endpoint' WHEN 'Test' THEN 'test function' ELSE lower(kind) END, {_WORDS('name')}),
  CASE WHEN coalesce(parent_qualified, '') <> '' THEN 'in ' || {_WORDS("regexp_extract(parent_qualified, '[^.]*$')")} END, nullif(array_to_string(rooted[greatest(len(rooted) - 2, 1):], ' '), ''), nullif(left(split_part(regexp_replace(docstring, '^\\s+|\\s+$', '', 'g'), '.', 1), 120), '')) AS text
  FROM (SELECT *, CASE WHEN pos IS NULL THEN p ELSE p[pos:] END AS rooted FROM (SELECT *, list_min(list_filter([list_position(p, 'src'), list_position(p, 'lib'), list_position(p, 'app'), list_position(p, 'pkg')], lambda x: x > 0)) AS pos
    FROM (SELECT *, list_filter(string_split(regexp_replace(file_path, '\\.[^./]+$', ''), '/'), lambda x: x <> '') AS p FROM n WHERE kind NOT IN ({_list(SKIPPED_FOR_EMBEDDING)})))))"""


@query(f", {_TEXT} SELECT qualified_name, text FROM tx")
def embedding_texts(spark, d):
    return E.texts(_nodes(spark, d)).select("qualified_name", "text")


@query(f""", {_TEXT}, tk AS (SELECT qualified_name, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM tx), good AS (SELECT * FROM tk WHERE length(t) >= 2 AND t NOT IN ({_list(LEXICAL_STOP)}))
  SELECT qualified_name, token, sum(w)::DOUBLE AS weight FROM (SELECT qualified_name, t AS token, 1.0 AS w FROM good UNION ALL SELECT qualified_name, '~' || left(t, 5), 0.5 FROM good WHERE length(t) > 5) GROUP BY 1, 2""")
def lexical_weights(spark, d):
    return E.token_weights(E.texts(_nodes(spark, d)))


@query(f""", {_TEXT} SELECT qualified_name, CASE WHEN len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({_list(LEXICAL_STOP)}))) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM tx""")
def lexical_vectors(spark, d):
    """Lengths of the vectors: 1 for every text with a word that counts, else 0."""
    return E.embed(E.texts(_nodes(spark, d)), E.provider("lexical", dims=256)).select("qualified_name", F.round(V.norm(F.col("vector").cast("array<double>")), 5).alias("length"))


_COS = "CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) > 0 THEN list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) ELSE 0 END"


@query(f""", c AS (SELECT q.vec_id AS query, s.vec_id, round({_COS.replace('(a,', '(q.embedding::DOUBLE[],').replace(', a)', ', q.embedding::DOUBLE[])').replace('(b,', '(s.embedding::DOUBLE[],').replace(', b)', ', s.embedding::DOUBLE[])')}, 9) AS cosine FROM embeddings q JOIN embeddings s ON q.vec_id <> s.vec_id WHERE q.vec_id % 20 = 0)
  SELECT query, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS r FROM c) WHERE r <= 10""")
def cosine_search(spark, d):
    """The ten most similar embeddings of every embedding whose id is divisible by 20, against all."""
    stored = table(spark, d, "embeddings")
    asked = stored.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_vector"))
    return E.search(stored, asked, 10, key="vec_id", vector="embedding", exclude_self=True).select("query", "vec_id", "cosine")


@query(""", s AS (SELECT vec_id::VARCHAR AS k, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5(vec_id::VARCHAR), k LIMIT 500)
  SELECT count(*) AS pairs, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS mean, round(stddev_pop(list_cosine_similarity(a.v, b.v)), 6) AS deviation FROM s a JOIN s b ON a.k < b.k""")
def cosine_spread(spark, d):
    return E.spread(table(spark, d, "embeddings"), key="vec_id", vector="embedding")


@query()
def approximate_search(spark, d):
    """As cosine_search, through lists of which the nearest are probed."""
    stored = table(spark, d, "embeddings")
    asked = stored.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_vector"))
    return E.approximate(stored, asked, 10, key="vec_id", vector="embedding", exclude_self=True).select("query", "vec_id", "cosine")


def _cosines(spark, d, hub: DataFrame) -> DataFrame:
    """(qualified_name, cosine) of all vectors to that of the hub; without one no rows."""
    held = _vectors(spark, d)
    asked = held.join(F.broadcast(hub), "qualified_name", "left_semi").select(F.col("vector").alias("qv"))
    return held.crossJoin(F.broadcast(asked)).select("qualified_name", F.round(V.cosine(F.col("vector"), F.col("qv")), 9).alias("cosine"))


# --- clusters ----------------------------------------------------------------------------------------------------------------


@query()
def kmeans_clusters(spark, d):
    found = C.kmeans(table(spark, d, "embeddings"), 64, least=50, key="vec_id", vector="embedding")
    return found.groupBy("cluster_id").agg(F.count("*").alias("size"))


@query()
def density_clusters(spark, d):
    found = C.density(table(spark, d, "embeddings"), 64, radius=0.9, key="vec_id", vector="embedding")
    return found.groupBy("cluster_id").agg(F.count("*").alias("size"))


@query("""SELECT DISTINCT qualified_name FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM (SELECT file_path, max(mtime_ns / 1e9) AS now FROM files GROUP BY 1) f WHERE f.file_path = s.file_path AND abs(s.mtime - f.now) <= 0.01)""")
def stale_symbols(spark, d):
    files = table(spark, d, "files").select("file_path", (F.col("mtime_ns") / F.lit(1e9)).alias("mtime"))
    return G.stale_symbols(table(spark, d, "symbols"), files).select("qualified_name").distinct()


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY 1, 2""")
def windowed_events(spark, d):
    return windowed_counts(table(spark, d, "events"))


def _labelled(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.col("label").alias("cluster_id")), rows


@query("""SELECT cluster_id, size, list(round(x, 6) ORDER BY i) AS centroid FROM (SELECT label AS cluster_id, i, avg(x) AS x, count(*) AS size FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1, 2""")
def cluster_centroids(spark, d):
    members, rows = _labelled(spark, d)
    return C.centroids(members, rows, "vec_id", "embedding").withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


_QUALITY = """cell AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cen AS MATERIALIZED (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM cell GROUP BY 1, 2) GROUP BY 1),
dr AS (SELECT * FROM (SELECT label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS r FROM embeddings) WHERE r <= 30),
sp AS (SELECT e.vec_id, e.label, min(list_distance(e.embedding::DOUBLE[], cen.c)) FILTER (cen.label = e.label) AS a, min(list_distance(e.embedding::DOUBLE[], cen.c)) FILTER (cen.label <> e.label) AS b FROM embeddings e CROSS JOIN cen GROUP BY 1, 2)"""


@query(f""", {_QUALITY} SELECT s.label AS cluster_id, s.size, round(coalesce(h.c, 1.0), 6) AS cohesion, round(g.d, 6) AS nearest, round(s.sil, 6) AS silhouette
  FROM (SELECT label, count(*) AS size, avg(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM sp GROUP BY 1) s
  LEFT JOIN (SELECT x.label, avg(list_cosine_similarity(x.v, y.v)) AS c FROM dr x JOIN dr y ON x.label = y.label AND x.r < y.r GROUP BY 1) h ON h.label = s.label
  LEFT JOIN (SELECT x.label, min(list_distance(x.c, y.c)) AS d FROM cen x JOIN cen y ON x.label <> y.label GROUP BY 1) g ON g.label = s.label""")
def cluster_quality(spark, d):
    members, rows = _labelled(spark, d)
    return C.quality(members, rows, key="vec_id", vector="embedding")


@query(f""", {_QUALITY}, h AS (SELECT x.label, avg(list_cosine_similarity(x.v, y.v)) AS c FROM dr x JOIN dr y ON x.label = y.label AND x.r < y.r GROUP BY 1), s AS (SELECT label, count(*) AS size, round(avg(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS sil FROM sp GROUP BY 1)
  SELECT count(*) AS clusters, 0.0::DOUBLE AS noise_ratio, round(avg(round(coalesce(h.c, 1.0), 6)), 6) AS cohesion, round(sum(sil * size) / sum(size), 6) AS silhouette, round(sum(sil * size) / sum(size), 6) > 0.1 AS is_good FROM s LEFT JOIN h ON h.label = s.label""")
def cluster_overall(spark, d):
    members, rows = _labelled(spark, d)
    return C.overall(C.quality(members, rows, key="vec_id", vector="embedding"), members)


_LABELS = f"""lt AS MATERIALIZED (SELECT cluster_id, q, p, unnest(list_filter(string_split(lower(regexp_replace(regexp_replace(array_to_string(CASE WHEN len(p) > 2 THEN list_concat([array_to_string(p[:len(p) - 2], '.')], p[len(p) - 1:]) ELSE p END, '_'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_'), lambda t: length(t) > 1 AND t NOT IN ({_list(LABEL_STOP)}))) AS t
  FROM (SELECT cluster_id, qualified_name AS q, string_split(qualified_name, '.') AS p FROM m WHERE cluster_id >= 0)),
tw AS (SELECT cluster_id, string_agg(t, ' ' ORDER BY r) AS w FROM (SELECT cluster_id, t, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, t) AS r FROM lt GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1),
tm AS (SELECT cluster_id, mo, n, sum(n) OVER (PARTITION BY cluster_id) AS size, row_number() OVER (PARTITION BY cluster_id ORDER BY mo IS NULL, n DESC, mo) AS r FROM (SELECT cluster_id, CASE WHEN contains(qualified_name, '.') THEN split_part(qualified_name, '.', 1) END AS mo, count(*) AS n FROM m WHERE cluster_id >= 0 GROUP BY 1, 2))"""


@query(f""", {_LABELS} SELECT tm.cluster_id, CASE WHEN w IS NULL THEN 'cluster_' || tm.cluster_id WHEN mo IS NOT NULL AND n >= size * 0.5 AND NOT contains(w, mo) THEN mo || ': ' || w ELSE w END AS label FROM tm LEFT JOIN tw ON tw.cluster_id = tm.cluster_id WHERE r = 1""")
def cluster_labels(spark, d):
    return C.labels(_members(spark, d))


_PAIRS = f"ud AS MATERIALIZED (SELECT least(source, target) AS a, greatest(source, target) AS b, sum({_case(COMMUNITY_WEIGHTS)}::DOUBLE) AS w FROM e GROUP BY 1, 2)"


@query(f", {_PAIRS} SELECT a, b, round(w, 6) AS w FROM ud")
def community_edges(spark, d):
    return C.undirected(_edges(spark, d)).withColumn("w", F.round("w", 6))


@query(f""", {_PAIRS}, j AS (SELECT w, coalesce(x.cluster_id::VARCHAR, 'alone ' || a) AS ca, coalesce(y.cluster_id::VARCHAR, 'alone ' || b) AS cb FROM ud LEFT JOIN m x ON x.qualified_name = a LEFT JOIN m y ON y.qualified_name = b),
  ds AS (SELECT sum(d * d) AS d2 FROM (SELECT sum(w) AS d FROM (SELECT ca AS c, w FROM j UNION ALL SELECT cb, w FROM j) GROUP BY c))
  SELECT round(sum(CASE WHEN ca = cb THEN w ELSE 0 END) / sum(w) - any_value(d2) / (4 * sum(w) * sum(w)), 6) AS modularity FROM j, ds""")
def stored_modularity(spark, d):
    return C.modularity(C.undirected(_edges(spark, d)), _members(spark, d))


@query()
def communities(spark, d):
    return C.communities(_edges(spark, d)).groupBy("cluster_id").agg(F.count("*").alias("size"))


@query()
def community_labels(spark, d):
    return C.stem_labels(C.communities(_edges(spark, d)), _nodes(spark, d))


# --- retrieval and export ----------------------------------------------------------------------------------------------------


def _retrieved(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    hits = _cosines(spark, d, _hub(edges, nodes)).where("cosine >= 0.1")
    scores = R.bridge(*R.rankable(nodes, edges)).select("qualified_name", F.col("score").alias("composite"))
    return Q.retrieve(hits, nodes, edges, scores, _members(spark, d)), nodes, edges


_RETRIEVE = f"""{_RANKABLE}, br AS MATERIALIZED (SELECT q, ln(1 + coalesce(i.c, 0) * coalesce(o.c, 0)) / ln(1 + size.c) AS v FROM rn CROSS JOIN size LEFT JOIN (SELECT t, count(*) AS c FROM l GROUP BY 1) i ON i.t = q LEFT JOIN outs o ON o.s = q),
hc AS MATERIALIZED (SELECT a.qualified_name AS q, round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 9) AS c FROM v a, v b WHERE b.qualified_name = (SELECT h FROM hub) AND len(list_filter(a.vector, lambda x: x <> 0)) > 0)"""


@query(f", {_RETRIEVE} SELECT q AS qualified_name, c AS cosine FROM hc WHERE c >= 0.1 ORDER BY c DESC, q LIMIT 20")
def retrieval_hits(spark, d):
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    return _cosines(spark, d, _hub(edges, nodes)).where("cosine >= 0.1").orderBy(F.desc("cosine"), "qualified_name").limit(20)


_RANKED = f""", {_RETRIEVE}, hit AS MATERIALIZED (SELECT q, c FROM hc WHERE c >= 0.1 ORDER BY c DESC, q LIMIT 20), head AS MATERIALIZED (SELECT q FROM hit ORDER BY c DESC, q LIMIT 5)""" + _first("SELECT q FROM head", 3, 26) + """,
  cand AS (SELECT coalesce(hit.q, bf.q) AS q, coalesce(c, 0) AS semantic, depth, coalesce(CASE WHEN depth = 0 THEN 1.0 ELSE 1 / (1 + ln(1 + depth / greatest((SELECT max(depth) FROM bf), 1))) END, 0) AS graph FROM hit FULL JOIN bf ON bf.q = hit.q),
  graded AS (SELECT cand.*, coalesce(br.v, 0) AS centrality, (m.cluster_id IS NOT NULL AND m.cluster_id IN (SELECT cluster_id FROM m WHERE qualified_name IN (FROM head)))::INT::DOUBLE AS cluster, n.file_path FROM cand LEFT JOIN br ON br.q = cand.q LEFT JOIN m ON m.qualified_name = cand.q LEFT JOIN n ON n.qualified_name = cand.q),
  best AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, q) AS rank FROM (SELECT *, round(0.40 * semantic + 0.25 * graph + 0.20 * centrality + 0.15 * cluster, 6) AS score FROM graded) ORDER BY score DESC, q LIMIT 10)"""


@query(_RANKED + """ SELECT rank, q AS qualified_name, score, round(semantic, 6) AS semantic, round(graph, 6) AS graph, round(centrality, 6) AS centrality, cluster, depth::INT AS depth, file_path FROM best""")
def retrieve(spark, d):
    return _retrieved(spark, d)[0].withColumn("rank", F.col("rank").cast("long"))


@query(_RANKED + """, blk AS (SELECT rank, rank || '. ' || coalesce('[' || n.kind || '] ', '') || q || chr(10) || '   ' || coalesce(best.file_path, '') || CASE WHEN range_start > 0 THEN ':' || range_start ELSE '' END || '  score ' || format('{:.4f}', score)
    || CASE WHEN coalesce(docstring, '') <> '' THEN chr(10) || '   ' || regexp_replace(docstring, '\\s+', ' ', 'g') ELSE '' END AS b FROM best LEFT JOIN n ON n.qualified_name = best.q),
  fit AS (SELECT *, 23 + sum(length(b) + 1) OVER (ORDER BY rank) <= 12000 AS kept FROM blk)
  SELECT '# Context for: the hub' || chr(10) || coalesce(string_agg(b, chr(10) ORDER BY rank) FILTER (kept), '') || CASE WHEN count(*) FILTER (NOT kept) > 0 THEN chr(10) || '… ' || count(*) FILTER (NOT kept) || ' more omitted' ELSE '' END AS context FROM fit""")
def context(spark, d):
    found, nodes, _ = _retrieved(spark, d)
    return Q.context(found, nodes, "the hub")


@query(f"""SELECT n.qualified_name AS symbol, n.kind, n.file_path || CASE WHEN range_start > 0 THEN ':' || range_start ELSE '' END AS location, n.language, coalesce(o.l, []) AS outgoing, coalesce(i.l, []) AS incoming FROM n
  LEFT JOIN (SELECT source AS q, list_sort(list(DISTINCT kind || ' ' || target)) AS l FROM e WHERE kind IN ({_list(Q.OUTGOING)}) GROUP BY 1) o ON o.q = n.qualified_name
  LEFT JOIN (SELECT q, list_sort(list(DISTINCT x)) AS l FROM (SELECT n.qualified_name AS q, kind_ || ' ' || source AS x FROM n JOIN (SELECT kind AS kind_, source, target FROM e WHERE kind IN ({_list(Q.INCOMING)})) t ON t.target = n.qualified_name
     UNION ALL SELECT n.qualified_name, kind_ || ' ' || source FROM n JOIN (SELECT kind AS kind_, source, target FROM e WHERE kind IN ({_list(Q.INCOMING)})) t ON t.target = n.name) GROUP BY 1) i ON i.q = n.qualified_name WHERE n.kind <> 'File'""")
def explain_all(spark, d):
    return Q.explain(_nodes(spark, d), _edges(spark, d))


@query(f"""SELECT source AS symbol, 'outgoing' AS side, kind || ' ' || target AS entry FROM e WHERE kind IN ({_list(Q.OUTGOING)}) AND source IN (SELECT qualified_name FROM n)
  UNION SELECT n.qualified_name, 'incoming', e.kind || ' ' || e.source FROM n JOIN e ON e.target = n.qualified_name WHERE e.kind IN ({_list(Q.INCOMING)}) UNION SELECT n.qualified_name, 'incoming', e.kind || ' ' || e.source FROM n JOIN e ON e.target = n.name WHERE e.kind IN ({_list(Q.INCOMING)})""")
def explain_links(spark, d):
    return Q.explain_links(_nodes(spark, d), _edges(spark, d))


def _views(spark, d):
    nodes, edges, members = _nodes(spark, d), _edges(spark, d), _members(spark, d)
    degree = R.bridge(*R.rankable(nodes, edges)).withColumnRenamed("score", "composite")
    labels = C.labels(members)
    return X.nodes_view(nodes, degree, members, labels), X.edges_view(edges), X.clusters_view(members, labels)


@query(f""", {_RETRIEVE}, th AS (SELECT v AS t FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS c FROM br) WHERE i = floor(c * 0.9))
  SELECT n.qualified_name AS id, coalesce(m.cluster_id, -1) AS cluster_id, round(coalesce(br.v, 0), 6) AS centrality, coalesce(coalesce(br.v, 0) >= (SELECT t FROM th), false) AS is_hotspot, round(20 + ln(1 + coalesce(br.v, 0) / (SELECT max(v) FROM br) * 10) / ln(11) * 40, 1) AS size
  FROM n LEFT JOIN br ON br.q = n.qualified_name LEFT JOIN m ON m.qualified_name = n.qualified_name""")
def export_nodes(spark, d):
    return _views(spark, d)[0].select("id", "cluster_id", "centrality", "is_hotspot", "size")


@query("SELECT 'e_' || edge_id AS id, source, target, kind, round(coalesce(confidence, 1.0), 3) AS confidence FROM e")
def export_edges(spark, d):
    return X.edges_view(_edges(spark, d))


@query(f""", {_LABELS}, lb AS (SELECT tm.cluster_id, CASE WHEN w IS NULL THEN 'cluster_' || tm.cluster_id WHEN mo IS NOT NULL AND n >= size * 0.5 AND NOT contains(w, mo) THEN mo || ': ' || w ELSE w END AS label FROM tm LEFT JOIN tw ON tw.cluster_id = tm.cluster_id WHERE r = 1)
  SELECT m.cluster_id, coalesce(any_value(lb.label), '') AS label, count(*) AS size, CASE WHEN m.cluster_id < 0 THEN '{X.GREY}' ELSE ([{_list(X.CLUSTER_COLOURS)}])[m.cluster_id % {len(X.CLUSTER_COLOURS)} + 1] END AS color FROM m LEFT JOIN lb ON lb.cluster_id = m.cluster_id WHERE m.cluster_id IS NOT NULL GROUP BY m.cluster_id""")
def export_clusters(spark, d):
    return _views(spark, d)[2]


@query(f""", {_RETRIEVE}, th AS (SELECT v AS t FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS c FROM br) WHERE i = floor(c * 0.9))
  SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM n JOIN br ON br.q = n.qualified_name WHERE br.v >= (SELECT t FROM th)) AS hotspot_count, (SELECT list_sort(list(DISTINCT language)) FROM n WHERE language <> '') AS languages,
  (SELECT count(*) FROM e) AS edge_count, (SELECT count(DISTINCT cluster_id) FROM m) AS cluster_count""")
def export_metadata(spark, d):
    return X.metadata(*_views(spark, d))


# --- ingestion ---------------------------------------------------------------------------------------------------------------


def _latest_files(spark, d) -> DataFrame:
    """The latest parse of every source file, its language told by the extension."""
    rows = table(spark, d, "parse_results").where(F.col("file_path").isNotNull())
    last = rows.groupBy("file_path").agg(F.max(F.struct("parsed_at", "source_text")).alias("v")).select("file_path", "v.source_text")
    return last.withColumn("language", walk.language_column(F.col("file_path"), walk.extension_map())).where("language IS NOT NULL")


@query("""SELECT qualified_name, kind, range_start FROM n WHERE FALSE""")
def ingested_missing(spark, d):
    """Function and method nodes whose file parses as Python and whose name and line the ingestion doesn't find there; there are none."""
    facts = ingest.extract(_latest_files(spark, d).where("language = 'python'"))
    broken = facts.where("fact = 'error'").select("file_path")
    seen = facts.where("fact = 'node'").select("file_path", "name", F.col("line").alias("range_start"))
    wanted = _nodes(spark, d).where(F.col("kind").isin("Function", "Method") & F.col("file_path").rlike(r"\.py$")).select("qualified_name", "kind", "name", "file_path", "range_start")
    return wanted.join(broken, "file_path", "left_anti").join(seen, ["file_path", "name", "range_start"], "left_anti").select("qualified_name", "kind", "range_start")


@query()
def ingested_nodes(spark, d):
    """What the ingestion of all source files finds, by language and kind."""
    return ingest.build(_latest_files(spark, d))[0].groupBy("language", "kind").agg(F.count("*").alias("nodes"))


@query()
def ingested_edges(spark, d):
    return ingest.build(_latest_files(spark, d))[1].groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("file_path").alias("files"))
