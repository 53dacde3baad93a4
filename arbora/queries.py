"""Queries of the general data operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import hierarchy as tree
from arbora.operators import increments, orphans
from arbora.session import shared_dir
from arbora.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return increments.capture(table(spark, d, "symbols"), table(spark, d, "files"), table(spark, d, "index_runs")).select("qualified_name").distinct()


def p1_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The same batch after its first run failed halfway, by another driver that finds the open plan in the folder."""
    tables = [table(spark, d, name) for name in ("symbols", "files", "index_runs")]
    folder = f"{shared_dir(spark)}/changelog-{uuid.uuid4().hex}"

    def fails(batch: DataFrame) -> DataFrame:
        raise InterruptedError

    try:
        increments.capture(*tables, folder, fails)
    except InterruptedError:
        pass
    return increments.capture(*tables, folder).select("qualified_name").distinct()


def p1_offsets(spark: SparkSession, d: str) -> DataFrame:
    offsets = increments.committed_offsets(table(spark, d, "files"), table(spark, d, "index_runs"))
    return offsets.select("path", "run_id", F.array_max("offsets").alias("last_offset"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return tree.circular(table(spark, d, "nodes")).select(F.col("id").alias("qualified_name"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    full = tree.hierarchy(table(spark, d, "nodes"))
    return full.where(F.col("state") == "tree").select(F.col("id").alias("qualified_name"), "root", F.col("depth").cast("int").alias("depth"), F.array_join("path", " > ").alias("path"), "subtree")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return tree.descendants(tree.hierarchy(table(spark, d, "nodes"))).select(F.col("id").alias("qualified_name"), "descendant", "distance")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "external_symbols")).select("edge_id", "side")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    report = orphans.orphan_report(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "external_symbols"))
    return report.select("side", F.date_format("period", "yyyy-MM").alias("period"), "refs", "orphans", "orphan_keys")


QUERIES = {f.__name__: f for f in (p1_found, p1_replayed, p1_offsets, p4_found, p4_hierarchy, p4_descendants, p7_found, p7_report)}

_PATHS = """
canon(raw, path) AS (
  SELECT raw, CASE WHEN s LIKE '/%' THEN '/' || ltrim(s, '/') ELSE s END FROM (
    SELECT raw, regexp_replace(regexp_replace(rtrim(regexp_replace(regexp_replace(regexp_replace(
      replace(raw, '\\', '/'), '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '(^|/)\\.$', '\\1'), '/'),
      '(^|/)[^/]+/\\.\\.(/|$)', '\\1'), '(^|/)[^/]+/\\.\\.(/|$)', '\\1') AS s
    FROM (SELECT file_path AS raw FROM symbols UNION SELECT file_path FROM files) WHERE raw IS NOT NULL)),
notes AS (
  SELECT c.path, f.run_id, f.mtime_ns FROM files f JOIN canon c ON c.raw = f.file_path
  WHERE f.run_id IN (SELECT run_id FROM index_runs WHERE status = 'ok')),
latest AS (SELECT * FROM notes n WHERE run_id = (SELECT max(run_id) FROM notes m WHERE m.path = n.path))
"""

_TREE = """
links AS (
  SELECT n.id, p.id AS parent FROM (SELECT qualified_name AS id, min(parent_qualified) AS parent FROM nodes WHERE qualified_name IS NOT NULL GROUP BY 1) n
  LEFT JOIN (SELECT DISTINCT qualified_name AS id FROM nodes WHERE trim(qualified_name) <> '') p ON n.parent = p.id)
"""

_ORPHANS = """
refs AS (
  SELECT DISTINCT edge_id, side, ref, seen FROM (
    SELECT edge_id, 'source' AS side, source AS ref, ingested_at AS seen FROM edges UNION ALL SELECT edge_id, 'target', target, ingested_at FROM edges)
  WHERE ref IS NOT NULL AND ref <> ''),
bad AS (
  SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM external_symbols x WHERE x.symbol = r.ref)
  AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.qualified_name = r.ref AND n.ingested_at <= r.seen AND (n.deleted_at IS NULL OR r.seen < n.deleted_at)))
"""

_DOWN = """
down AS (
  SELECT id, id AS root, 0 AS depth, id AS path, [id] AS trail FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, d.root, d.depth + 1, d.path || ' > ' || l.id, list_append(d.trail, l.id) FROM down d JOIN links l ON l.parent = d.id)
"""

SQL = {
    "p1_found": f"""WITH {_PATHS}
      SELECT DISTINCT s.qualified_name FROM symbols s LEFT JOIN canon c ON c.raw = s.file_path
      WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.path = c.path AND abs(s.mtime - l.mtime_ns / 1e9) <= 1e-6)""",
    "p1_offsets": f"WITH {_PATHS} SELECT path, run_id, max(mtime_ns) AS last_offset FROM latest GROUP BY 1, 2",
    "p4_found": f"""WITH RECURSIVE {_TREE},
      up AS (SELECT id AS start, parent AS here FROM links WHERE parent IS NOT NULL UNION SELECT u.start, l.parent FROM up u JOIN links l ON l.id = u.here WHERE l.parent IS NOT NULL)
      SELECT DISTINCT start AS qualified_name FROM up WHERE start = here""",
    "p4_hierarchy": f"""WITH RECURSIVE {_TREE}, {_DOWN},
      below AS (SELECT x AS id, count(*) AS n FROM (SELECT unnest(trail) AS x FROM down) GROUP BY 1)
      SELECT d.id AS qualified_name, d.root, d.depth::INT AS depth, d.path, b.n AS subtree FROM down d JOIN below b ON b.id = d.id""",
    "p4_descendants": f"""WITH RECURSIVE {_TREE}, {_DOWN}
      SELECT x AS qualified_name, id AS descendant, (depth - p + 1)::INT AS distance FROM (SELECT id, depth, unnest(trail) AS x, generate_subscripts(trail, 1) AS p FROM down) WHERE x <> id""",
    "p7_found": f"WITH {_ORPHANS} SELECT edge_id, side FROM bad",
    "p7_report": f"""WITH {_ORPHANS}, total AS (SELECT side, strftime(seen, '%Y-%m') AS period, count(*) AS refs FROM refs GROUP BY 1, 2),
      b AS (SELECT side, strftime(seen, '%Y-%m') AS period, count(*) AS orphans, count(DISTINCT ref) AS orphan_keys FROM bad GROUP BY 1, 2)
      SELECT t.side, t.period, t.refs, coalesce(b.orphans, 0) AS orphans, coalesce(b.orphan_keys, 0) AS orphan_keys
      FROM total t LEFT JOIN b ON b.side = t.side AND b.period IS NOT DISTINCT FROM t.period""",
}
SQL["p1_replayed"] = SQL["p1_found"]
