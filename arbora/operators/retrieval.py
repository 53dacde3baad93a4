"""Hybrid retrieval: vector hits, graph distance, centrality and clusters fused; context, impact and explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.traversal import bfs
from arbora.plans.optimizer import TOKENS_PER_NODE, TraversalPlan, optimize
from arbora.schema import IMPACT_EDGES
from arbora.session import cut

# The parts of a candidate's score, and the edge kinds an explanation shows.
PARTS = {"semantic": 0.40, "graph": 0.25, "centrality": 0.20, "cluster": 0.15}
OUTGOING = ("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS", "EXTENDS", "USES")
INCOMING = ("CALLS", "INHERITS", "IMPLEMENTS", "EXTENDS", "TESTS")


def depth_score(depth: Column, deepest: Column) -> Column:
    return F.when(depth == 0, 1.0).otherwise(1 / (1 + F.log1p(depth / deepest)))


def retrieve(hits: DataFrame, nodes: DataFrame, edges: DataFrame, scores: DataFrame, members: DataFrame, seeds: DataFrame | None = None, k: int = 10, max_tokens: int = 4000, hops: int = 3, intent: str | None = None) -> DataFrame:
    """(rank, qualified_name, score, semantic, graph, centrality, cluster, depth, file_path): the best candidates of a query.

    hits: (qualified_name, cosine) of the query's nearest vectors, best 2 * k; seeds: (qualified_name), by default the first five hits.
    Candidates are the hits and what the walk from the seeds reaches; the parts' weights are PARTS. At most k and at most as many as
    max_tokens has room for at 150 tokens each; ties by name.
    """
    best = cut(hits.orderBy(F.desc("cosine"), "qualified_name").limit(2 * k))
    first = cut(best.orderBy(F.desc("cosine"), "qualified_name").limit(5))
    starts = seeds if seeds is not None else first
    plan = optimize(TraversalPlan(max_depth=hops, max_nodes=200), max_tokens, intent)
    walked = bfs(nodes, edges, starts.select("qualified_name"), plan).select("qualified_name", "depth")
    deepest = walked.agg(F.greatest(F.max("depth"), F.lit(1)).alias("deepest"))
    asked = members.join(first.select("qualified_name"), "qualified_name", "left_semi").select(F.col("cluster_id").alias("c")).distinct()
    candidates = best.join(walked, "qualified_name", "full_outer")  # at most 2 * k + 200 rows
    small = F.broadcast(candidates)
    graded = scores.select("qualified_name", F.col("composite").alias("centrality")).join(small, "qualified_name", "right")
    placed = members.select("qualified_name", "cluster_id").join(F.broadcast(graded), "qualified_name", "right").join(F.broadcast(asked), F.col("cluster_id") == F.col("c"), "left")
    filed = nodes.select("qualified_name", "file_path").join(F.broadcast(placed), "qualified_name", "right").crossJoin(F.broadcast(deepest))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = filed.select("qualified_name", "file_path", "depth", zero(F.col("cosine")).alias("semantic"), zero(depth_score(F.col("depth"), F.coalesce("deepest", F.lit(1)))).alias("graph"), zero(F.col("centrality")).alias("centrality"), F.col("c").isNotNull().cast("double").alias("cluster")).dropDuplicates(["qualified_name"])
    score = sum((w * F.col(p) for p, w in PARTS.items()), F.lit(0.0))
    ranked = rows.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "qualified_name").limit(min(k, max_tokens // TOKENS_PER_NODE))
    order = Window.partitionBy(F.lit("all")).orderBy(F.desc("score"), "qualified_name")  # k rows
    return ranked.select(F.row_number().over(order).alias("rank"), "qualified_name", "score", *[F.round(p, 6).alias(p) for p in PARTS], "depth", "file_path")


def budget(rows: DataFrame, tokens: Column, limit: int, order: list) -> DataFrame:
    """The rows in order for as long as their running token sum stays within the limit."""
    window = Window.partitionBy(F.lit("all")).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(tokens).over(window)).where(F.col("running") <= limit).drop("running")


def context(results: DataFrame, nodes: DataFrame, query: str, max_tokens: int = 3000) -> DataFrame:
    """(context): one row, the results as numbered blocks of text under a header, four characters a token at most, then what was left out."""
    known = nodes.join(F.broadcast(results.select("qualified_name")), "qualified_name", "left_semi")
    joined = F.broadcast(results).join(known.select("qualified_name", "kind", "docstring", "range_start").dropDuplicates(["qualified_name"]), "qualified_name", "left")
    line = F.concat(F.col("rank"), F.lit(". "), F.coalesce(F.concat(F.lit("["), F.col("kind"), F.lit("] ")), F.lit("")), F.col("qualified_name"))
    place = F.concat(F.lit("   "), F.coalesce("file_path", F.lit("")), F.when(F.col("range_start") > 0, F.concat(F.lit(":"), F.col("range_start"))).otherwise(""), F.lit("  score "), F.format_number("score", 4))
    doc = F.when(F.coalesce("docstring", F.lit("")) != "", F.concat(F.lit("\n   "), F.regexp_replace("docstring", r"\s+", " "))).otherwise("")
    header = f"# Context for: {query}\n"
    blocks = joined.select("rank", F.concat(line, F.lit("\n"), place, doc).alias("block"))
    window = Window.partitionBy(F.lit("all")).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fitted = blocks.withColumn("used", F.sum(F.length("block") + 1).over(window) + len(header))
    kept = F.col("used") <= 4 * max_tokens
    row = fitted.agg(F.sort_array(F.collect_list(F.when(kept, F.struct("rank", "block")))).alias("l"), F.sum((~kept).cast("int")).alias("omitted"))
    tail = F.when(F.col("omitted") > 0, F.concat(F.lit("\n… "), F.col("omitted"), F.lit(" more omitted"))).otherwise("")
    return row.select(F.concat(F.lit(header), F.array_join(F.col("l.block"), "\n"), tail).alias("context"))


def impact(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 4) -> DataFrame:
    """(qualified_name, depth, direct, kind, file_path, is_test): everything that a change of the roots reaches, inbound, at most 500.

    direct marks the sources of edges into a root; these are listed even if they are no nodes, with null kind and file.
    """
    plan = TraversalPlan(max_depth=max_depth, max_nodes=500, direction="inbound", edge_kinds=IMPACT_EDGES)
    walked = bfs(nodes, edges, roots, plan).where("depth > 0").select("qualified_name", "depth")
    ends = roots.select(F.col("qualified_name").alias("target")).distinct()
    callers = edges.where(F.col("kind").isin(list(IMPACT_EDGES))).join(F.broadcast(ends), "target", "left_semi").select(F.col("source").alias("qualified_name")).distinct().withColumn("direct", F.lit(True))
    both = walked.join(callers, "qualified_name", "full_outer")
    known = nodes.select("qualified_name", "kind", "file_path").dropDuplicates(["qualified_name"])
    return both.join(known, "qualified_name", "left").select("qualified_name", "depth", F.coalesce("direct", F.lit(False)).alias("direct"), "kind", "file_path", F.coalesce(F.col("kind") == "Test", F.lit(False)).alias("is_test"))


def impact_summary(reached: DataFrame) -> DataFrame:
    """One row: how many direct callers, reached nodes, files and tests, and the greatest depth."""
    return reached.agg(F.sum(F.col("direct").cast("int")).alias("direct_callers"), F.count("depth").alias("transitive"), F.count_distinct(F.when(F.col("depth").isNotNull(), F.col("file_path"))).alias("files"), F.sum((F.col("is_test") & F.col("depth").isNotNull()).cast("int")).alias("tests"), F.max("depth").alias("deepest"))


def explain_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, side, entry), one row a link: side is outgoing or incoming, entry ``kind name``; edges into a node's bare name count.

    The form without lists, for nodes that a good part of all edges lead to.
    """
    out = edges.where(F.col("kind").isin(list(OUTGOING))).select(F.col("source").alias("symbol"), F.lit("outgoing").alias("side"), F.concat_ws(" ", "kind", "target").alias("entry"))
    entering = edges.where(F.col("kind").isin(list(INCOMING))).select(F.col("target").alias("t"), F.concat_ws(" ", "kind", "source").alias("entry")).distinct()
    named = nodes.select(F.col("qualified_name").alias("symbol"), F.explode(F.array_distinct(F.array("qualified_name", "name"))).alias("t"))
    into = named.join(entering, "t").select("symbol", F.lit("incoming").alias("side"), "entry")
    return out.distinct().join(nodes.select(F.col("qualified_name").alias("symbol")).distinct(), "symbol", "left_semi").unionByName(into.distinct())


def explain(nodes: DataFrame, edges: DataFrame, symbol: str | None = None, limit: int | None = None) -> DataFrame:
    """(symbol, kind, location, language, outgoing, incoming): what nodes matching the symbol, or all nodes, are linked to.

    outgoing and incoming are sorted entries of ``explain_links``. File nodes are dropped after the limit.
    """
    matched = nodes
    if symbol is not None:
        matched = nodes.where((F.col("qualified_name") == symbol) | (F.col("name") == symbol))
    if limit is not None:
        matched = matched.orderBy((F.col("qualified_name") == F.lit(symbol)).desc(), "qualified_name").limit(limit)
    matched = matched.where(F.col("kind") != "File")
    lists = explain_links(matched, edges).groupBy(F.col("symbol").alias("q")).agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("entry")))).alias(s) for s in ("outgoing", "incoming")])
    empty = F.expr("cast(array() as array<string>)")
    location = F.concat("file_path", F.when(F.col("range_start") > 0, F.concat(F.lit(":"), F.col("range_start"))).otherwise(""))
    joined = matched.join(lists, F.col("qualified_name") == F.col("q"), "left")
    return joined.select(F.col("qualified_name").alias("symbol"), "kind", location.alias("location"), "language", F.coalesce("outgoing", empty).alias("outgoing"), F.coalesce("incoming", empty).alias("incoming"))
