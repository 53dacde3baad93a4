"""Walks over the graph: level by level as joins, or, where the order of single steps matters, in one task of bounded size."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.plans.optimizer import TraversalPlan
from arbora.schema import OTHER_WEIGHT, TAINT_EDGES, WEIGHTS
from arbora.session import cut

#: Edges that the order-bound walks may take into one task; beyond it they ask for a smaller depth or fewer edge kinds.
LOCAL_EDGES = 1_000_000
#: A walk that returns no more nodes than this broadcasts its frontier; one of ALL_NODES is not limited at all.
BROADCAST_NODES, ALL_NODES = 20_000, 1 << 40


def adjacency(edges: DataFrame, direction: str = "outbound", kinds: Sequence[str] | None = None) -> DataFrame:
    """(src, dst, kind, seq): the edges in walking direction; seq orders the steps from one node, outbound ones first."""
    rows = edges if kinds is None else edges.where(F.col("kind").isin(list(kinds)))
    out = rows.select(F.col("source").alias("src"), F.col("target").alias("dst"), "kind", F.struct(F.lit(0).alias("d"), "edge_id").alias("seq"))
    back = rows.select(F.col("target").alias("src"), F.col("source").alias("dst"), "kind", F.struct(F.lit(1).alias("d"), "edge_id").alias("seq"))
    return {"outbound": lambda: out, "inbound": lambda: back, "bidirectional": lambda: out.unionByName(back)}[direction]()


def bfs(nodes: DataFrame, edges: DataFrame, starts: DataFrame, plan: TraversalPlan = TraversalPlan()) -> DataFrame:
    """(qualified_name, kind, depth, path, edge_kinds, visit): breadth-first, first discovery wins, in visiting order, at most max_nodes.

    A node is found by the parent that was visited first, among its edges by the first; ``visit`` orders the result. Starts that are no
    nodes, null starts and repeated starts count once or not at all. Without a filter on node kinds no level needs more rows than
    may still be returned, so up to BROADCAST_NODES the frontier is broadcast and the edges are never shuffled; else both are.
    """
    known = nodes.select("qualified_name", "kind").dropDuplicates(["qualified_name"])
    steps = adjacency(edges, plan.direction, plan.edge_kinds)
    first = starts.select("qualified_name").distinct().join(known, "qualified_name")
    key = F.array(F.struct(F.lit(0).alias("d"), F.conv(F.substring(F.md5("qualified_name"), 1, 15), 16, 10).cast("long").alias("edge_id")))
    empty = F.expr("cast(array() as array<string>)")
    bounded = plan.node_kinds is None and plan.max_nodes <= BROADCAST_NODES
    rows = first.select("qualified_name", "kind", F.lit(0).alias("depth"), F.array("qualified_name").alias("path"), empty.alias("edge_kinds"), key.alias("visit"))
    level = cut(rows.orderBy("visit").limit(plan.max_nodes) if bounded else rows)
    levels, left = [level], plan.max_nodes
    for depth in range(1, plan.max_depth + 1):
        size = level.count()
        left -= size if bounded else 0
        if not size or left <= 0:
            break
        came = level.select(F.col("qualified_name").alias("src"), "path", "edge_kinds", "visit")
        came = F.broadcast(came) if bounded else came
        seen = levels[0].select("qualified_name")
        for one in levels[1:]:
            seen = seen.union(one.select("qualified_name"))
        reached = steps.join(came, "src").groupBy(F.col("dst").alias("qualified_name")).agg(F.min(F.struct("visit", "seq", "path", "edge_kinds", F.col("kind").alias("via"))).alias("m"))
        fresh = reached.join(F.broadcast(seen) if bounded else seen, "qualified_name", "left_anti").join(known, "qualified_name")
        rows = fresh.select("qualified_name", "kind", F.lit(depth).alias("depth"), F.concat("m.path", F.array("qualified_name")).alias("path"), F.concat("m.edge_kinds", F.array("m.via")).alias("edge_kinds"), F.concat("m.visit", F.array("m.seq")).alias("visit"))
        level = cut(rows.orderBy("visit").limit(left) if bounded else rows)
        levels.append(level)
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    if not bounded:
        if plan.node_kinds is not None:
            out = out.where(F.col("kind").isin(list(plan.node_kinds)))
        if plan.max_nodes < ALL_NODES:
            out = out.orderBy("depth", "visit").limit(plan.max_nodes)
    return out


def depths(edges: DataFrame, starts: DataFrame, max_depth: int, direction: str = "outbound", kinds: Sequence[str] | None = None, nodes: DataFrame | None = None, per_start: bool = False) -> DataFrame:
    """(qualified_name, depth), or (start, qualified_name, depth): least depth up to max_depth from any, or from each, start.

    For any number of starts; frontier and visited sets are shuffled. With nodes, only names of nodes are walked to.
    """
    steps = adjacency(edges, direction, kinds).select("src", "dst").distinct()
    if nodes is not None:
        steps = steps.join(nodes.select(F.col("qualified_name").alias("dst")).distinct(), "dst", "left_semi")
    steps = cut(steps)
    keys = (["start"] if per_start else []) + ["qualified_name"]
    names = starts.select("qualified_name").where(F.col("qualified_name").isNotNull()).distinct()
    first = names.select(F.col("qualified_name").alias("start"), "qualified_name") if per_start else names
    seen = cut(first.withColumn("depth", F.lit(0)))
    level = seen
    for depth in range(1, max_depth + 1):
        moved = level.withColumnRenamed("qualified_name", "src").join(steps, "src").select(*keys[:-1], F.col("dst").alias("qualified_name")).distinct()
        level = cut(moved.join(seen.select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, plan: TraversalPlan | None = None) -> DataFrame:
    """(path): the first of the shortest outbound paths, no row if there is none; from a node to itself it is the node.

    Without a plan there is no limit on depth, the direction is outbound, and names need not be nodes.
    """
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([([start],)], "path array<string>")
    plan = plan or TraversalPlan(max_depth=1 << 30)
    steps = adjacency(edges, plan.direction, plan.edge_kinds)
    seen = level = cut(spark.createDataFrame([(start, [start])], "qualified_name string, path array<string>"))
    for _ in range(plan.max_depth):
        came = level.select(F.col("qualified_name").alias("src"), "path")
        moved = steps.join(came, "src").groupBy(F.col("dst").alias("qualified_name")).agg(F.min(F.struct("path", "seq")).alias("m"))
        level = cut(moved.join(seen.select("qualified_name"), "qualified_name", "left_anti").select("qualified_name", F.concat("m.path", F.array("qualified_name")).alias("path")))
        hit = level.where(F.col("qualified_name") == end)
        if not hit.isEmpty():
            return hit.select("path")
        if level.isEmpty():
            break
        seen = cut(seen.select("qualified_name").unionByName(level.select("qualified_name"))).withColumn("path", F.lit(None).cast("array<string>"))
    return spark.createDataFrame([], "path array<string>")


def taint(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int = 6, kinds: Sequence[str] = TAINT_EDGES) -> DataFrame:
    """(source, sink, depth, path, edge_kinds): one flow per source and sink it reaches within max_depth, by the first shortest path."""
    steps = adjacency(edges, "outbound", kinds)
    first = sources.select(F.col("qualified_name").alias("source")).distinct()
    empty = F.expr("cast(array() as array<string>)")
    level = cut(first.select("source", F.col("source").alias("at"), F.array("source").alias("path"), empty.alias("edge_kinds")))
    seen, found = level.select("source", "at"), None
    ends = sinks.select(F.col("qualified_name").alias("at")).distinct()
    for depth in range(1, max_depth + 1):
        moved = level.join(steps, F.col("at") == F.col("src")).groupBy("source", F.col("dst").alias("to")).agg(F.min(F.struct("path", "seq", "edge_kinds", "kind")).alias("m"))
        rows = moved.select("source", F.col("to").alias("at"), F.concat("m.path", F.array("to")).alias("path"), F.concat("m.edge_kinds", F.array("m.kind")).alias("edge_kinds"))
        level = cut(rows.join(seen, ["source", "at"], "left_anti"))
        hits = level.join(ends, "at", "left_semi").select("source", F.col("at").alias("sink"), F.lit(depth).alias("depth"), "path", "edge_kinds")
        found = hits if found is None else found.unionByName(hits)
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("source", "at"))
    return found


def size_estimate(edges: DataFrame, starts: DataFrame, kinds: Sequence[str] | None = None, hops: int = 2) -> DataFrame:
    """(nodes): how many names lie within two outbound hops, the starts included."""
    return depths(edges, starts, hops, "outbound", kinds).agg(F.count("*").alias("nodes"))


# --- walks whose order of steps matters --------------------------------------------------------------------------------------


def _local(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int, kinds, limit: int) -> DataFrame:
    """(src, dst, kind, seq) of all edges that leave a name within depth of a start, checked to be at most ``limit``."""
    near = depths(edges, starts, depth, "outbound", kinds).select(F.col("qualified_name").alias("src"))
    rows = cut(adjacency(edges, "outbound", kinds).join(near, "src", "left_semi").select("src", "dst", "kind", F.col("seq.edge_id").alias("seq")))
    if rows.count() > limit:
        raise ValueError(f"more than {limit} edges within {depth} steps: choose a smaller depth or fewer edge kinds")
    return rows


def _kernel(walk, links: DataFrame, starts: DataFrame, marks: DataFrame, schema: str) -> DataFrame:
    """Runs a walk over bounded inputs in one task. marks: (name, kind, score) of the nodes the links touch."""
    tag = lambda df, part: df.select(F.lit(part).alias("part"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("src", "string"), ("dst", "string"), ("kind", "string"), ("seq", "long"), ("score", "double"))])
    touched = links.select(F.col("src").alias("n")).union(links.select("dst")).union(starts.select("qualified_name")).distinct()
    known = marks.join(touched, F.col("src") == F.col("n"), "left_semi")
    rows = tag(links, "link").unionByName(tag(starts.select(F.col("qualified_name").alias("src")), "start")).unionByName(tag(known, "node"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        links = frame[frame["part"] == "link"].sort_values("seq")
        out: dict[str, list[tuple[str, str]]] = {}
        for s, d, k in zip(links["src"], links["dst"], links["kind"]):
            out.setdefault(s, []).append((d, k))
        known = frame[frame["part"] == "node"]
        begin = sorted(set(frame[frame["part"] == "start"]["src"]))
        return walk(out, dict(zip(known["src"], known["kind"])), dict(zip(known["src"], known["score"].fillna(0.0))), begin)

    return rows.groupBy().applyInPandas(run, schema)


def _marks(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("qualified_name").alias("src"), "kind", F.lit(0.0).alias("score")).dropDuplicates(["src"])


WALK = "visit int, qualified_name string, depth int, cost double, path array<string>"


def dfs(nodes: DataFrame, edges: DataFrame, starts: DataFrame, plan: TraversalPlan = TraversalPlan(), limit: int = LOCAL_EDGES) -> DataFrame:
    """(visit, qualified_name, depth, cost, path): depth-first in pre-order over nodes, steps in edge order; cost is null.

    A filter on node kinds only limits what is returned. All edges within max_depth go to one task, at most ``limit``.
    """

    def walk(out, kinds, _, begin):
        rows, seen = [], set()
        for start in begin:
            pile = [(start, 0, [start])]
            while pile and len(rows) < plan.max_nodes:
                name, depth, path = pile.pop()
                if name in seen or name not in kinds or depth > plan.max_depth:
                    continue
                seen.add(name)
                if plan.node_kinds is None or kinds[name] in plan.node_kinds:
                    rows.append((len(rows), name, depth, None, path))
                pile += [(d, depth + 1, [*path, d]) for d, _ in reversed(out.get(name, ())) if d not in seen]
        return pd.DataFrame(rows, columns=["visit", "qualified_name", "depth", "cost", "path"])

    return _kernel(walk, _local(nodes, edges, starts, plan.max_depth, plan.edge_kinds, limit), starts, _marks(nodes), WALK)


def weighted_bfs(nodes: DataFrame, edges: DataFrame, starts: DataFrame, plan: TraversalPlan = TraversalPlan(), weights: dict[str, float] | None = None, default: float = 1.0, limit: int = LOCAL_EDGES) -> DataFrame:
    """(visit, qualified_name, depth, cost, path): the cheapest first; a name counts as reached when first queued, not when cheapest.

    A node of a kind that is filtered out is neither returned nor walked through. Bounded like ``dfs``.
    """
    weights = weights or {}

    def walk(out, kinds, _, begin):
        heap = [(0.0, 0, s, [s]) for s in begin if s in kinds]
        seen, rows = {s for _, _, s, _ in heap}, []
        heapq.heapify(heap)
        while heap and len(rows) < plan.max_nodes:
            cost, depth, name, path = heapq.heappop(heap)
            if name not in kinds or depth > plan.max_depth or plan.node_kinds is not None and kinds[name] not in plan.node_kinds:
                continue
            rows.append((len(rows), name, depth, cost, path))
            for d, k in out.get(name, ()):
                if d not in seen:
                    seen.add(d)
                    heapq.heappush(heap, (cost + weights.get(k, default), depth + 1, d, [*path, d]))
        return pd.DataFrame(rows, columns=["visit", "qualified_name", "depth", "cost", "path"])

    return _kernel(walk, _local(nodes, edges, starts, plan.max_depth, plan.edge_kinds, limit), starts, _marks(nodes), WALK)


def beam(nodes: DataFrame, edges: DataFrame, starts: DataFrame, scores: DataFrame, max_depth: int = 4, width: int = 30, least: float = 0.001, decay: float = 0.8, limit: int = LOCAL_EDGES) -> DataFrame:
    """(visit, qualified_name, depth, cost, path), cost being the score: best first, each expansion keeps its ``width`` best steps.

    A step scores the mean of both ends' scores times the edge's weight times decay per depth. The walk ends at the first node below
    ``least``; the width * max_depth best are returned. scores: (qualified_name, score), 0 where a name has none. Bounded like ``dfs``.
    """

    def walk(out, _, score, begin):
        heap = [(-score.get(s, 0.0), s, 0, [s]) for s in begin]
        heapq.heapify(heap)
        seen, rows = set(), []
        while heap:
            value, name, depth, path = heapq.heappop(heap)
            if name in seen:
                continue
            if -value < least:
                break
            seen.add(name)
            rows.append((name, depth, -value, path))
            if depth < max_depth:
                steps = sorted((-(0.5 * -value + 0.5 * score.get(d, 0.0)) * WEIGHTS.get(k, OTHER_WEIGHT) * decay**depth, d) for d, k in out.get(name, ()) if d not in seen)
                for v, d in steps[:width]:
                    heapq.heappush(heap, (v, d, depth + 1, [*path, d]))
        rows.sort(key=lambda r: (-r[2], r[0]))
        return pd.DataFrame([(i, *r) for i, r in enumerate(rows[: width * max_depth])], columns=["visit", "qualified_name", "depth", "cost", "path"])

    marks = scores.select(F.col("qualified_name").alias("src"), F.lit(None).cast("string").alias("kind"), "score")
    return _kernel(walk, _local(nodes, edges, starts, max_depth, None, limit), starts, marks, WALK)
