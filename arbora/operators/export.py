"""The graph as rows and JSON for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Colours by kind, and the cycle of cluster colours.
KIND_COLOURS = {"File": "#1F6FEB", "Module": "#388BFD", "Namespace": "#388BFD", "Class": "#3FB950", "Struct": "#3FB950", "Interface": "#79C0FF", "Function": "#F78166", "Method": "#FF7B72", "Endpoint": "#FF6E40", "Test": "#D2A8FF", "Constant": "#FFA657", "Enum": "#FFA657", "Type": "#79C0FF", "Variable": "#6E7681", "Parameter": "#6E7681", "Callsite": "#6E7681"}
GREY = "#8B949E"
CLUSTER_COLOURS = ("#58A6FF", "#3FB950", "#FF7B72", "#D2A8FF", "#FFA657", "#79C0FF", "#56D364", "#FF6E40", "#E3B341", "#BC8CFF", "#89DDFF", "#F78166")


def cluster_colour(column: str):
    cycle = F.array(*[F.lit(c) for c in CLUSTER_COLOURS])
    return F.when(F.col(column) < 0, GREY).otherwise(F.element_at(cycle, (F.pmod(F.col(column), F.lit(len(CLUSTER_COLOURS))) + 1).cast("int")))


def hotspot_threshold(scores: DataFrame) -> DataFrame:
    """(threshold): the composite at index floor(0.9 n) of the rising order, exactly; no row without scores."""
    n = scores.count()
    if not n:
        return scores.select(F.col("composite").alias("threshold")).limit(0)
    return scores.select(F.col("composite").alias("threshold")).orderBy(F.desc("threshold")).limit(n - int(n * 0.90)).agg(F.min("threshold").alias("threshold"))


def nodes_view(nodes: DataFrame, scores: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per node with score, cluster, size and colours; nodes without score or cluster get 0 and -1."""
    s = scores.select("qualified_name", "composite", "fan_in", "fan_out")
    joined = nodes.join(s, "qualified_name", "left").join(members.select("qualified_name", "cluster_id"), "qualified_name", "left").join(F.broadcast(labels.select("cluster_id", "label")), "cluster_id", "left")
    most = scores.agg(F.max("composite").alias("most"))
    joined = joined.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(hotspot_threshold(scores).agg(F.max("threshold").alias("threshold"))))
    composite = F.coalesce("composite", F.lit(0.0))
    part = F.when(F.coalesce("most", F.lit(0.0)) > 0, composite / F.col("most")).otherwise(0.0)
    colours = F.create_map(*[F.lit(x) for pair in KIND_COLOURS.items() for x in pair])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = joined.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    return rows.select(
        F.col("qualified_name").alias("id"), "name", "kind", F.col("file_path").alias("file"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("range_start", F.lit(0)).alias("line"),
        "cluster_id", F.coalesce("label", F.lit("")).alias("cluster_label"), F.round(composite, 6).alias("centrality"), zero("fan_in"), zero("fan_out"),
        F.coalesce(composite >= F.col("threshold"), F.lit(False)).alias("is_hotspot"), F.coalesce("is_test", F.lit(False)).alias("is_test"), F.substring(F.coalesce("docstring", F.lit("")), 1, 200).alias("docstring"),
        F.coalesce(F.try_element_at(colours, F.col("kind")), F.lit(GREY)).alias("color"), cluster_colour("cluster_id").alias("cluster_color"), F.round(20 + F.log1p(part * 10) / F.log1p(F.lit(10.0)) * 40, 1).alias("size"),
    )


def edges_view(edges: DataFrame) -> DataFrame:
    """(id, source, target, kind, confidence); ids are stable, being the edges' own."""
    return edges.select(F.concat(F.lit("e_"), F.col("edge_id")).alias("id"), "source", "target", "kind", F.round(F.coalesce("confidence", F.lit(1.0)), 3).alias("confidence"))


def clusters_view(members: DataFrame, labels: DataFrame) -> DataFrame:
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.join(F.broadcast(labels.select("cluster_id", "label")), "cluster_id", "left").select("cluster_id", F.coalesce("label", F.lit("")).alias("label"), "size", cluster_colour("cluster_id").alias("color"))


def metadata(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row of counts and the sorted languages, from the views above."""
    n = nodes.agg(F.count("*").alias("node_count"), F.sum(F.col("is_hotspot").cast("int")).alias("hotspot_count"), F.sort_array(F.collect_set(F.when(F.col("language") != "", F.col("language")))).alias("languages"))
    return n.crossJoin(edges.agg(F.count("*").alias("edge_count"))).crossJoin(clusters.agg(F.count("*").alias("cluster_count")))


def write_document(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, folder: str) -> None:
    """JSON lines of the three views and the metadata under the folder; every part is written by the executors."""
    for name, df in (("nodes", nodes), ("edges", edges), ("clusters", clusters), ("metadata", metadata(nodes, edges, clusters))):
        df.write.mode("overwrite").json(f"{folder}/{name}")
