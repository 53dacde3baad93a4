"""Clusters of nodes: k-means, communities, labels, quality, and the cluster store."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import vectors as V
from arbora.functions.words import label_tokens
from arbora.schema import COMMUNITY_WEIGHTS, weight_column
from arbora.session import cut

#: Weighted edges up to which one task runs the modularity moves.
LOCAL_LINKS = 300_000


def kmeans(items: DataFrame, dims: int, least: int = 5, key: str = "qualified_name", vector: str = "vector", max_k: int = 2_000) -> DataFrame:
    """(key, cluster_id): k-means over unit vectors with k = max(2, n // least), seed 42; one cluster 0 if there are fewer than ``least``.

    k stays at most max_k, since the model is held by every task. Vectors that aren't ``dims`` finite components are left out.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = cut(items.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).where(V.usable(F.col("v"), dims)))
    n = rows.count()
    if n < max(least, 2):
        return rows.select(key, F.lit(0).alias("cluster_id"))
    size = V.norm(F.col("v"))
    unit = rows.select(key, array_to_vector(F.transform("v", lambda x: F.when(size > 0, x / size).otherwise(0.0))).alias("features"))
    model = KMeans(k=min(max(2, n // least), max_k), seed=42, maxIter=10).fit(unit)
    return model.transform(unit).select(key, F.col("prediction").alias("cluster_id"))


def density(items: DataFrame, dims: int, radius: float = 0.5, min_samples: int = 3, least: int = 5, key: str = "qualified_name", vector: str = "vector", tables: int = 6) -> DataFrame:
    """(key, cluster_id): connected components of dense unit vectors, -1 for noise; ids by falling size.

    Two vectors are linked if they lie within radius, as found by random projections; a vector is dense with min_samples links, a vector
    that isn't joins a dense one it is linked to. Components of fewer than ``least`` vectors are noise. Results differ from those of
    a density hierarchy over a reduced space: one radius holds for all clusters.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    size = V.norm(F.col("v"))
    rows = items.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(V.usable(F.col("v"), dims) & (size > 0))
    unit = cut(rows.select("k", array_to_vector(F.transform("v", lambda x: x / size)).alias("unit")))
    if unit.isEmpty():
        return unit.select(F.col("k").alias(key), F.lit(-1).alias("cluster_id"))
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hash", bucketLength=2 * radius, numHashTables=tables, seed=42).fit(unit)
    pairs = model.approxSimilarityJoin(unit, unit, radius, "d").select(F.col("datasetA.k").alias("a"), F.col("datasetB.k").alias("b")).where("a <> b").distinct()
    links = cut(pairs)
    dense = cut(links.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("a"))
    inner = cut(links.join(dense, "a", "left_semi").join(dense.select(F.col("a").alias("b")), "b", "left_semi"))
    label = cut(dense.select("a", F.col("a").alias("c")))
    while True:
        near = inner.join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        moved = label.join(near, "a", "left").select("a", F.least("c", F.coalesce("m", "c")).alias("c"), "c")
        named = moved.toDF("a", "c", "old")
        jump = named.select(F.col("a").alias("c"), F.col("c").alias("further"))
        after = cut(named.join(jump, "c", "left").select("a", F.least("c", F.coalesce("further", "c")).alias("c"), "old"))
        label = after.select("a", "c")
        if after.where("c <> old").isEmpty():
            break
    edge = links.join(dense, "a", "left_anti").join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("c"))
    every = label.unionByName(edge)
    sizes = every.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ids = sizes.withColumn("cluster_id", F.row_number().over(Window.partitionBy(F.lit("all")).orderBy(F.desc("n"), "c")) - 1)
    found = every.join(ids.select("c", "cluster_id"), "c").select("a", "cluster_id")
    return unit.join(found, F.col("k") == F.col("a"), "left").select(F.col("k").alias(key), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def centroids(members: DataFrame, items: DataFrame, key: str = "qualified_name", vector: str = "vector") -> DataFrame:
    """(cluster_id, size, centroid): the mean vector of the members of every cluster but noise (-1); sums combine before the shuffle."""
    joined = members.where("cluster_id >= 0").join(items.select(key, F.col(vector).cast("array<double>").alias("v")), key)
    cells = joined.select("cluster_id", F.posexplode("v").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return cells.groupBy("cluster_id").agg(F.max("n").alias("size"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("l")).select("cluster_id", "size", F.col("l.x").alias("centroid"))


def assign_noise(members: DataFrame, items: DataFrame, centres: DataFrame, key: str = "qualified_name", vector: str = "vector") -> DataFrame:
    """(key, cluster_id): noise put to the nearest centroid; the centroids are one row a cluster and are broadcast."""
    noise = members.where("cluster_id < 0").join(items.select(key, F.col(vector).cast("array<double>").alias("v")), key)
    near = noise.select(key, "v").crossJoin(F.broadcast(centres.select(F.col("cluster_id").alias("c"), "centroid")))
    best = near.groupBy(key).agg(F.min(F.struct(V.distance(F.col("v"), F.col("centroid")).alias("d"), "c")).alias("m")).select(key, F.col("m.c").alias("cluster_id"))
    return members.where("cluster_id >= 0").select(key, "cluster_id").unionByName(best)


def labels(members: DataFrame, top: int = 3, key: str = "qualified_name") -> DataFrame:
    """(cluster_id, label): the most frequent words of the member names, led by the module that at least half of them share.

    Ties go to the word that comes first; a cluster without words is ``cluster_<id>``. Noise gets no label.
    """
    inside = members.where("cluster_id >= 0").select("cluster_id", F.col(key).alias("q"))
    tokens = inside.select("cluster_id", F.explode(label_tokens(F.col("q"))).alias("t")).groupBy("cluster_id", "t").agg(F.count("*").alias("n"))
    ranked = tokens.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "t"))).where(F.col("r") <= top)
    words = ranked.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), " ").alias("words"))
    module = F.when(F.instr("q", ".") > 0, F.element_at(F.split("q", r"\."), 1))
    modules = inside.groupBy("cluster_id", module.alias("m")).agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.sum("n").alias("size"), F.min(F.when(F.col("m").isNotNull(), F.struct((-F.col("n")).alias("n"), "m"))).alias("b"))
    led = F.when((-F.col("b.n") >= F.col("size") * 0.5) & ~F.contains("words", F.col("b.m")), F.concat("b.m", F.lit(": "), F.col("words"))).otherwise(F.col("words"))
    return modules.join(words, "cluster_id", "left").select("cluster_id", F.coalesce(led, F.col("words"), F.concat(F.lit("cluster_"), F.col("cluster_id"))).alias("label"))


def quality(members: DataFrame, items: DataFrame, sample: int = 30, key: str = "qualified_name", vector: str = "vector") -> DataFrame:
    """(cluster_id, size, cohesion, nearest, silhouette) per cluster.

    cohesion: mean cosine of the pairs among at most ``sample`` members, drawn by the MD5 of their key; 1 for a single one. nearest: distance
    to the closest other centroid, null for an only cluster. silhouette: mean of (b - a) / max(a, b), a and b being a member's distance
    to its own and the closest other centroid, 0 for an only cluster.
    """
    centres = cut(centroids(members, items, key, vector))
    rows = members.where("cluster_id >= 0").join(items.select(key, F.col(vector).cast("array<double>").alias("v")), key)
    drawn = rows.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.md5(F.col(key).cast("string")), key))).where(F.col("r") <= sample)
    a, b = drawn.select("cluster_id", F.col("r").alias("ra"), F.col("v").alias("va")), drawn.select(F.col("cluster_id").alias("c"), F.col("r").alias("rb"), F.col("v").alias("vb"))
    pairs = a.join(b, (F.col("cluster_id") == F.col("c")) & (F.col("ra") < F.col("rb")))  # at most sample ** 2 / 2 a cluster
    cohesion = pairs.groupBy("cluster_id").agg(F.avg(V.cosine(F.col("va"), F.col("vb"))).alias("cohesion"))
    x, y = centres.select("cluster_id", F.col("centroid").alias("mine")), centres.select(F.col("cluster_id").alias("other"), F.col("centroid").alias("theirs"))
    gaps = x.join(F.broadcast(y), F.col("cluster_id") != F.col("other")).groupBy("cluster_id").agg(F.min(V.distance(F.col("mine"), F.col("theirs"))).alias("nearest"))
    spans = rows.select("cluster_id", key, "v").crossJoin(F.broadcast(y)).withColumn("d", V.distance(F.col("v"), F.col("theirs")))
    per = spans.groupBy("cluster_id", key).agg(F.min(F.when(F.col("other") == F.col("cluster_id"), F.col("d"))).alias("a"), F.min(F.when(F.col("other") != F.col("cluster_id"), F.col("d"))).alias("b"))
    most = F.greatest("a", "b")
    silhouette = per.groupBy("cluster_id").agg(F.avg(F.when(F.col("b").isNull() | (most == 0), 0.0).otherwise((F.col("b") - F.col("a")) / most)).alias("silhouette"))
    joined = centres.select("cluster_id", "size").join(cohesion, "cluster_id", "left").join(gaps, "cluster_id", "left").join(silhouette, "cluster_id", "left")
    return joined.select("cluster_id", "size", F.round(F.coalesce("cohesion", F.lit(1.0)), 6).alias("cohesion"), F.round("nearest", 6).alias("nearest"), F.round(F.coalesce("silhouette", F.lit(0.0)), 6).alias("silhouette"))


def overall(per_cluster: DataFrame, members: DataFrame) -> DataFrame:
    """(clusters, noise_ratio, cohesion, silhouette, is_good): good is a silhouette above 0.1 with less than 0.3 noise."""
    noise = members.agg(F.round(F.coalesce(F.avg((F.col("cluster_id") < 0).cast("double")), F.lit(0.0)), 6).alias("noise_ratio"))
    row = per_cluster.agg(F.count("*").alias("clusters"), F.round(F.avg("cohesion"), 6).alias("cohesion"), F.round(F.sum(F.col("silhouette") * F.col("size")) / F.sum("size"), 6).alias("silhouette"))
    joined = row.crossJoin(noise)
    return joined.select("clusters", "noise_ratio", "cohesion", "silhouette", ((F.col("silhouette") > 0.1) & (F.col("noise_ratio") < 0.3)).alias("is_good"))


# --- communities -------------------------------------------------------------------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w), a <= b: one edge a pair, weights by kind added up."""
    w = weight_column(F.col("kind"), COMMUNITY_WEIGHTS)
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(w).alias("w"))


def modularity(pairs: DataFrame, members: DataFrame, key: str = "qualified_name") -> DataFrame:
    """(modularity): of an assignment (key, cluster_id) over undirected weighted pairs; names without cluster stand alone."""
    own = members.select(F.col(key).alias("n"), F.col("cluster_id").cast("string").alias("c"))
    side = lambda s: own.select(F.col("n").alias(s), F.col("c").alias(f"c{s}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "w", F.coalesce("ca", F.concat(F.lit("alone "), F.col("a"))).alias("ca"), F.coalesce("cb", F.concat(F.lit("alone "), F.col("b"))).alias("cb"))
    inner = joined.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    ends = joined.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("d"))
    total = ends.agg(F.sum(F.col("d") * F.col("d")).alias("d2"))
    return inner.crossJoin(total).select(F.round(F.col("inside") / F.col("m") - F.col("d2") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))


def communities(edges: DataFrame, local_links: int = LOCAL_LINKS, rounds: int = 12) -> DataFrame:
    """(qualified_name, cluster_id): communities by modularity, ids by falling size.

    Nodes move to the neighbouring community of the greatest gain and communities are merged to nodes, again and again. While there
    are more than local_links weighted pairs both are joins, with at most ``rounds`` of moves before a merger; what is left then is
    done by one task until nothing improves, in the order of names.
    """
    pairs = cut(undirected(edges))
    placed = pairs.select(F.explode(F.array("a", "b")).alias("qualified_name")).distinct().withColumn("community", F.col("qualified_name"))
    size = pairs.count()
    while size > local_links:
        moved = _moves(pairs, rounds)
        to = moved.select(F.col("name").alias("community"), F.col("community").alias("now"))
        placed = cut(placed.join(to, "community", "left").select("qualified_name", F.coalesce("now", "community").alias("community")))
        ends = pairs.join(moved.select(F.col("name").alias("a"), F.col("community").alias("ca")), "a").join(moved.select(F.col("name").alias("b"), F.col("community").alias("cb")), "b")
        pairs = cut(ends.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
        before, size = size, pairs.count()
        if size == before:
            break  # no node gains by moving
    if size <= local_links:
        final = pairs.groupBy().applyInPandas(_louvain, "qualified_name string, community string").select(F.col("qualified_name").alias("community"), F.col("community").alias("now"))
        placed = placed.join(final, "community").select("qualified_name", F.col("now").alias("community"))
    placed = cut(placed)
    sizes = placed.groupBy("community").agg(F.count("*").alias("n"), F.min("qualified_name").alias("first"))
    return placed.join(_by_size(sizes), "community").select("qualified_name", "cluster_id")


def _by_size(sizes: DataFrame) -> DataFrame:
    """(community, cluster_id) of (community, n, first): ranks by falling size and name, counted within sizes so that no task ranks all."""
    each = sizes.groupBy("n").agg(F.count("*").alias("c"))
    # one row a size: sizes that differ sum up to the number of names, so there are few
    before = each.withColumn("before", F.sum("c").over(Window.partitionBy(F.lit("all")).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("n").orderBy("first")) - 1 + F.coalesce("before", F.lit(0))
    return sizes.join(F.broadcast(before.select("n", "before")), "n").select("community", rank.cast("int").alias("cluster_id"))


def _moves(pairs: DataFrame, rounds: int) -> DataFrame:
    """(name, community) after rounds of moves by modularity from a community a name; only half of the names may move in a round, so
    that neighbours don't swap for ever. Ends early when two rounds move nothing."""
    inner = pairs.where("a <> b")
    links = cut(inner.select("a", "b", "w").unionByName(inner.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("name"), "w").groupBy("name").agg(F.sum("w").alias("degree"))
    own = cut(degrees.select("name", "degree", F.col("name").alias("community")))
    total = own.agg(F.sum("degree").alias("t")).first()["t"] or 1.0
    idle = 0
    for step in range(rounds):
        held = own.groupBy("community").agg(F.sum("degree").alias("held"))
        near = links.join(own.select(F.col("name").alias("b"), "community"), "b").groupBy(F.col("a").alias("name"), "community").agg(F.sum("w").alias("w"))
        stay = own.select("name", "community", F.lit(0.0).alias("w"))
        offers = near.unionByName(stay).groupBy("name", "community").agg(F.sum("w").alias("w")).join(held, "community").join(own.select("name", "degree", F.col("community").alias("old")), "name")
        is_own = F.col("community") == F.col("old")
        gain = F.round(F.col("w") - F.col("degree") * (F.col("held") - F.when(is_own, F.col("degree")).otherwise(0.0)) / F.lit(total), 9)
        best = offers.groupBy("name", "degree", "old").agg(F.min(F.struct((-gain).alias("loss"), (~is_own).alias("other"), "community")).alias("m"))
        may = F.pmod(F.xxhash64("name", F.lit(step // 2)) + step, F.lit(2)) == 0
        moved = cut(best.select("name", "degree", F.when(may, F.col("m.community")).otherwise(F.col("old")).alias("community"), (may & F.col("m.other")).alias("moved")))
        own = moved.select("name", "degree", "community")
        idle = idle + 1 if moved.where("moved").isEmpty() else 0
        if idle == 2:
            break
    return own.select("name", "community")


def stem_labels(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cluster_id, label): the most common file name without extension among a community's nodes, ties by name; members without a
    file give ``cluster_<id>``."""
    stem = F.regexp_replace(F.element_at(F.split("file_path", r"[/\\\\]"), -1), r"\.[^.]*$", "")
    named = members.join(nodes.select("qualified_name", stem.alias("stem")), "qualified_name", "left").groupBy("cluster_id", "stem").agg(F.count("*").alias("n"))
    best = named.groupBy("cluster_id").agg(F.min(F.struct(F.col("stem").isNull().alias("none"), (-F.col("n")).alias("less"), "stem")).alias("m"))
    return best.select("cluster_id", F.coalesce("m.stem", F.concat(F.lit("cluster_"), F.col("cluster_id"))).alias("label"))


def trivial(items: DataFrame, key: str = "qualified_name") -> DataFrame:
    """(key, cluster_id): all in cluster 0, for inputs too small to be clustered and engines without a clusterer."""
    return items.select(key, F.lit(0).alias("cluster_id"))


def _louvain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["a", "b"])
    names = sorted(set(frame["a"]) | set(frame["b"]))
    index = {n: i for i, n in enumerate(names)}
    links: list[dict[int, float]] = [{} for _ in names]
    loops = [0.0] * len(names)
    for a, b, w in zip(frame["a"].map(index), frame["b"].map(index), frame["w"]):
        if a == b:
            loops[a] += 2 * w
        else:
            links[a][b] = links[a].get(b, 0.0) + w
            links[b][a] = links[b].get(a, 0.0) + w
    of, total = list(range(len(names))), sum(loops) + sum(sum(x.values()) for x in links)
    while total > 0:
        n = len(links)
        own = list(range(n))
        degree = [loops[i] + sum(links[i].values()) for i in range(n)]
        held = degree[:]
        improved, moved = False, True
        while moved:
            moved = False
            for i in range(n):
                near: dict[int, float] = {}
                for j, w in links[i].items():
                    near[own[j]] = near.get(own[j], 0.0) + w
                held[own[i]] -= degree[i]
                gain = lambda c: near.get(c, 0.0) - degree[i] * held[c] / total  # noqa: E731, B023
                best = max([own[i], *sorted(near)], key=lambda c: (round(gain(c), 12), c == own[i], -c))
                if gain(best) > gain(own[i]) + 1e-12:
                    own[i], moved, improved = best, True, True
                held[own[i]] += degree[i]
        if not improved:
            break
        ids = {c: k for k, c in enumerate(dict.fromkeys(own))}
        of = [ids[own[x]] for x in of]
        merged: list[dict[int, float]] = [{} for _ in ids]
        inner = [0.0] * len(ids)
        for i in range(n):
            a = ids[own[i]]
            inner[a] += loops[i]
            for j, w in links[i].items():
                b = ids[own[j]]
                if a == b:
                    inner[a] += w
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        links, loops = merged, inner
    return pd.DataFrame({"qualified_name": names, "community": [str(c) for c in of]})


def memberships(community: DataFrame | None, semantic: DataFrame | None) -> DataFrame:
    """The communities if there are any, else the semantic clusters; noise has no membership."""
    return (community if community is not None else semantic).where("cluster_id >= 0").select("qualified_name", "cluster_id")


def stored_members(members: DataFrame) -> DataFrame:
    """One cluster a name: the least wins where rows disagree; null names are left out."""
    return members.where(F.col("qualified_name").isNotNull()).groupBy("qualified_name").agg(F.min("cluster_id").alias("cluster_id"))
