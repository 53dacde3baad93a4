"""Centrality and personalised ranking over the rankable part of the graph.

Rank vectors are iterated as joins: one weighted edge per pair, ranks joined to it by source, one sum per target. Where nodes and edges
are few, by a bound that doesn't depend on the data, one task iterates over arrays instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.graph import between
from arbora.operators.traversal import depths
from arbora.schema import RANKED_EDGES, SEMANTIC_KINDS, weight_column
from arbora.session import cut, release, shared_folder, spread

#: Weighted edges plus nodes up to which one task iterates.
LOCAL_LINKS = 500_000

#: Links plus names up to which the tasks of betweenness hold the graph: 8 bytes a link and 28 a name. Arcs taken at once in a level.
HELD_LINKS, HELD_ARCS = 10_000_000, 1_000_000

#: Rows (start, name) of betweenness by joins that a batch of starts has at most.
WALKED = 100_000_000


def rankable(nodes: DataFrame, edges: DataFrame, semantic_only: bool = True, kinds: Sequence[str] = RANKED_EDGES) -> tuple[DataFrame, DataFrame]:
    """(names, links): (qualified_name) of the ranked nodes and (src, dst) of the ranked edges between them, parallel ones kept."""
    kept = nodes.where(F.col("kind").isin(list(SEMANTIC_KINDS))) if semantic_only else nodes
    names = kept.select("qualified_name").distinct()
    return names, between(edges.where(F.col("kind").isin(list(kinds))), names).select(F.col("source").alias("src"), F.col("target").alias("dst"))


def _power_local(rows: DataFrame, alpha: float, rounds: int, tolerance: float, renormalise: bool, norm: str) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = frame[frame["dst"].isna()].sort_values("src")
        names = nodes["src"].to_numpy()
        index = {n: i for i, n in enumerate(names)}
        links = frame[frame["dst"].notna()]
        src, dst = links["src"].map(index).to_numpy(np.int64), links["dst"].map(index).to_numpy(np.int64)
        share, seat = links["w"].to_numpy(np.float64), nodes["w"].to_numpy(np.float64)
        n = len(names)
        loose = np.ones(n, bool)
        loose[src] = False
        rank = seat.copy() if renormalise else np.full(n, 1.0 / max(n, 1))
        for _ in range(rounds):
            spread = np.bincount(dst, rank[src] * share, n)
            new = (1 - alpha) * seat + alpha * (spread + rank[loose].sum() / max(n, 1)) if norm == "rank" else spread
            if renormalise and new.sum() > 0:
                new /= new.sum()
            if norm == "l2":
                new /= np.sqrt((new**2).sum()) or 1.0
            gap = np.abs(new - rank).max() if renormalise else np.abs(new - rank).sum()
            rank = new
            if gap < tolerance * (1 if renormalise else n):
                break
        return pd.DataFrame({"qualified_name": names, "score": rank})

    return rows.groupBy().applyInPandas(run, "qualified_name string, score double")


def _power(names: DataFrame, links: DataFrame, seats: DataFrame, alpha: float, rounds: int, tolerance: float, renormalise: bool = False, norm: str = "rank", local_links: int = LOCAL_LINKS) -> DataFrame:
    """(qualified_name, score). links: (src, dst, w), w the share of the source's score that goes to dst; seats: (qualified_name, seat)."""
    links = cut(links)
    nodes = cut(names.join(seats, "qualified_name", "left").select("qualified_name", F.coalesce("seat", F.lit(0.0)).alias("seat")))
    n = nodes.count()
    if n + links.count() <= local_links:
        rows = links.select("src", "dst", "w").unionByName(nodes.select(F.col("qualified_name").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("seat").alias("w")))
        return _power_local(rows, alpha, rounds, tolerance, renormalise, norm)
    senders = links.select(F.col("src").alias("qualified_name")).distinct().withColumn("sends", F.lit(True))
    start = F.col("seat") if renormalise else F.lit(1.0 / n)
    rank = cut(nodes.join(senders, "qualified_name", "left").select("qualified_name", "seat", F.coalesce("sends", F.lit(False)).alias("sends"), start.alias("score")))
    for step in range(rounds):
        spread = links.join(rank.select(F.col("qualified_name").alias("src"), "score"), "src").groupBy(F.col("dst").alias("qualified_name")).agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        loose = rank.agg(F.sum(F.when(~F.col("sends"), F.col("score")).otherwise(0.0)).alias("loose"))
        got = F.coalesce("got", F.lit(0.0))
        new = (1 - alpha) * F.col("seat") + alpha * (got + F.col("loose") / n) if norm == "rank" else got
        moved = rank.join(spread, "qualified_name", "left").crossJoin(F.broadcast(loose)).select("qualified_name", "seat", "sends", F.col("score").alias("old"), new.alias("score"))
        if renormalise or norm == "l2":
            moved = cut(moved)
            size = moved.agg(F.sum("score").alias("one"), F.sqrt(F.sum(F.col("score") ** 2)).alias("two")).first()
            scale = size["one"] if renormalise else size["two"]
            moved = moved.withColumn("score", F.col("score") / F.lit(scale or 1.0))
        moved = cut(moved)
        gap = moved.agg((F.max if renormalise else F.sum)(F.abs(F.col("score") - F.col("old"))).alias("g")).first()["g"] if tolerance > 0 else 1.0
        rank = moved.select("qualified_name", "seat", "sends", "score")
        if gap < tolerance * (1 if renormalise else n):
            break
    return rank.select("qualified_name", "score")


def pagerank(names: DataFrame, links: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-10, simple: bool = False, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(qualified_name, score): ranks that sum to 1; what nodes without links hold is spread over all. simple: parallel links count once."""
    if simple:
        links = links.distinct()
    n = names.count()
    merged = links.groupBy("src", "dst").agg(F.count("*").alias("m"))
    shares = merged.join(merged.groupBy("src").agg(F.sum("m").alias("total")), "src").select("src", "dst", (F.col("m") / F.col("total")).alias("w"))
    return _power(names, shares, names.withColumn("seat", F.lit(1.0 / max(n, 1))), alpha, rounds, tolerance, local_links=local_links)


def eigenvector(names: DataFrame, links: DataFrame, rounds: int = 20, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(qualified_name, score): power iteration over the undirected graph, length 1 every round, the greatest score 1 at the end."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    scores = _power(names, both, names.withColumn("seat", F.lit(0.0)), 1.0, rounds, 0.0, norm="l2", local_links=local_links)
    top = scores.agg(F.max("score").alias("top"))
    return scores.crossJoin(F.broadcast(top)).select("qualified_name", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("score"))


def directed_eigenvector(names: DataFrame, links: DataFrame, rounds: int = 500, tolerance: float = 1e-6, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(qualified_name, score): power iteration along the links, each pair once, length 1 every round; the greatest score 1 at the end.

    A start of equal scores is added to every round, which keeps the direction and lets acyclic parts settle. If the scores still
    change after ``rounds``, or vanish, the share of the greatest fan-in stands in for them.
    """
    pairs = links.select("src", "dst").distinct().withColumn("w", F.lit(1.0))
    stays = names.select(F.col("qualified_name").alias("src"), F.col("qualified_name").alias("dst"), F.lit(1.0).alias("w"))
    every = cut(pairs.unionByName(stays))
    seats = names.withColumn("seat", F.lit(0.0))
    last = cut(_power(names, every, seats, 1.0, rounds, tolerance, norm="l2", local_links=local_links))
    step = every.join(last.withColumnRenamed("qualified_name", "src"), "src").groupBy(F.col("dst").alias("qualified_name")).agg(F.sum("score").alias("next"))
    size = step.agg(F.sqrt(F.sum(F.col("next") ** 2)).alias("size"))
    gap = last.join(step, "qualified_name").crossJoin(F.broadcast(size)).agg(F.sum(F.abs(F.col("next") / F.col("size") - F.col("score"))).alias("g"), F.max("score").alias("top"), F.count("*").alias("n")).first()
    if gap["n"] and gap["top"] and gap["g"] <= 2 * tolerance * gap["n"]:
        return last.select("qualified_name", (F.col("score") / F.lit(gap["top"])).alias("score"))
    degree = bridge(names, links)
    most = degree.agg(F.max("fan_in").alias("most"))
    return degree.crossJoin(F.broadcast(most)).select("qualified_name", F.when(F.col("most") > 0, F.col("fan_in") / F.col("most")).otherwise(0.0).alias("score"))


def bridge(names: DataFrame, links: DataFrame) -> DataFrame:
    """(qualified_name, fan_in, fan_out, score): ln(1 + in * out) / ln(1 + n)."""
    ends = links.select(F.explode(F.array(F.struct(F.col("dst").alias("q"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("q"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counts = ends.groupBy("e.q").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    n = names.agg(F.count("*").alias("n"))
    joined = names.join(counts, F.col("qualified_name") == F.col("q"), "left").crossJoin(F.broadcast(n))
    fan_in, fan_out = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    return joined.select("qualified_name", fan_in.alias("fan_in"), fan_out.alias("fan_out"), (F.log1p(fan_in * fan_out) / F.log1p("n")).alias("score"))


def closeness(names: DataFrame, links: DataFrame, sources: int = 100, hops: int = 3) -> DataFrame:
    """(qualified_name, score): 1 / (1 + mean hop) at which directed walks from the sources reach a node within ``hops``, else 0.

    Sources are the ``sources`` names with the least MD5, the same at every run.
    """
    drawn = names.orderBy(F.md5("qualified_name"), "qualified_name").limit(sources)
    walked = depths(links.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("x").alias("kind"), F.lit(0).alias("edge_id")), drawn, hops, per_start=True)
    mean = walked.where("depth > 0").groupBy("qualified_name").agg(F.avg("depth").alias("mean"))
    return names.join(mean, "qualified_name", "left").select("qualified_name", F.coalesce(1 / (1 + F.col("mean")), F.lit(0.0)).alias("score"))


def closeness_exact(names: DataFrame, links: DataFrame, limit: int = 2_000) -> DataFrame:
    """(qualified_name, score): closeness over the undirected graph, scaled by the share of names reached; at most ``limit`` names.

    It walks from every name, so its work grows with the square of the names; ``closeness`` is the measure beyond the limit.
    """
    n = names.count()
    if n > limit:
        raise ValueError(f"more than {limit} names: use closeness")
    both = links.select("src", "dst").union(links.select("dst", "src"))
    walked = depths(both.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("x").alias("kind"), F.lit(0).alias("edge_id")), names, max(n, 1), per_start=True)
    sums = walked.where("depth > 0").groupBy("qualified_name").agg(F.count("*").alias("r"), F.sum("depth").alias("s"))
    score = F.when(F.col("s") > 0, F.col("r") / F.col("s") * F.col("r") / max(n - 1, 1)).otherwise(0.0)
    return names.join(sums, "qualified_name", "left").select("qualified_name", F.coalesce(score, F.lit(0.0)).alias("score"))


def _arcs(first: np.ndarray, to: np.ndarray, level: np.ndarray):
    """(v, w) of all arcs that leave the level's names, HELD_ARCS at a time."""
    ends = np.cumsum(first[level + 1] - first[level])
    begins = np.concatenate([[0], ends[:-1]])
    for low in range(0, int(ends[-1]) if len(ends) else 0, HELD_ARCS):
        high = min(int(ends[-1]), low + HELD_ARCS)
        i, j = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(begins, high))
        n = np.minimum(ends[i:j], high) - np.maximum(begins[i:j], low)
        yield np.repeat(level[i:j], n), to[np.arange(low, high) + np.repeat(first[level[i:j]] - begins[i:j], n)]


def _dependencies(first: np.ndarray, to: np.ndarray, starts) -> np.ndarray:
    """What the shortest paths from the starts give to every name, by levels. Neighbours of v: to[first[v]:first[v + 1]]."""
    n = len(first) - 1
    total, far, paths, held = np.zeros(n), np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
    for start in starts:
        far[start], paths[start] = 0, 1.0
        levels = [np.array([start], np.int64)]
        while len(levels[-1]):
            depth, found = len(levels), [np.empty(0, np.int64)]
            for v, w in _arcs(first, to, levels[-1]):
                fresh = np.unique(w[far[w] < 0])
                far[fresh] = depth
                found.append(fresh.astype(np.int64))
                on = far[w] == depth
                np.add.at(paths, w[on], paths[v[on]])
            levels.append(np.concatenate(found))
        for depth in range(len(levels) - 1, 0, -1):
            for w, v in _arcs(first, to, levels[depth]):
                back = far[v] == depth - 1
                v, w = v[back], w[back]
                np.add.at(held, v, paths[v] / paths[w] * (1 + held[w]))
            total[levels[depth]] += held[levels[depth]]
        seen = np.concatenate(levels)
        far[seen], paths[seen], held[seen] = -1, 0.0, 0.0
    return total


def _between_held(arcs: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """(id, part): the arcs (a, b), written once in order, are read by every task; starts: (id)."""
    spark = arcs.sparkSession
    parts = spread(arcs)
    with shared_folder(spark) as folder:
        arcs.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")).repartitionByRange(parts, "a").sortWithinPartitions("a", "b").write.parquet(folder)

        def count(frames):
            own = np.concatenate([np.empty(0, np.int64), *(f["id"].to_numpy(np.int64) for f in frames)])
            if not len(own):
                return
            files, root = pyarrow.fs.FileSystem.from_uri(folder)
            degree, to = np.zeros(n, np.int64), []
            infos = files.get_file_info(pyarrow.fs.FileSelector(root))
            for path in sorted(i.path for i in infos if i.is_file and not i.base_name.startswith(("_", "."))):  # by number of the part, thus by a
                with files.open_input_file(path) as source:
                    for batch in pyarrow.parquet.ParquetFile(source).iter_batches(1 << 20):
                        np.add.at(degree, batch.column("a").to_numpy(), 1)
                        to.append(batch.column("b").to_numpy())
            total = _dependencies(np.concatenate([[0], np.cumsum(degree)]), np.concatenate([np.empty(0, np.int32), *to]), own)
            some = np.flatnonzero(total)
            for at in range(0, len(some), 1 << 16):
                yield pd.DataFrame({"id": some[at : at + (1 << 16)], "part": total[some[at : at + (1 << 16)]]})

        return cut(starts.repartition(parts, "id").mapInPandas(count, "id long, part double").groupBy("id").agg(F.sum("part").alias("part")))


def _between_joined(arcs: DataFrame, starts: list[int], n: int) -> DataFrame:
    """(id, part), level by level as joins, as many starts at once as have at most WALKED rows."""
    spark = arcs.sparkSession
    arcs, sums = cut(arcs), []
    step = max(1, WALKED // max(n, 1))
    for at in range(0, len(starts), step):
        levels = [cut(spark.createDataFrame([(s, s, 1.0) for s in starts[at : at + step]], "s long, v long, paths double"))]
        while True:
            reached = levels[-1].join(arcs, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
            for level in levels[-2:]:  # a neighbour of a level is in it, before it or after it
                reached = reached.join(level.select("s", "v"), ["s", "v"], "left_anti")
            reached = cut(reached)
            if reached.isEmpty():
                break
            levels.append(reached)
        given = None
        while len(levels) > 1:
            level = levels.pop()
            held = F.coalesce("sent", F.lit(0.0)) * F.col("paths") if given is not None else F.lit(0.0)
            level = cut((level.join(given, ["s", "v"], "left") if given is not None else level).select("s", "v", "paths", held.alias("held")))
            sums.append(cut(level.where("held > 0").groupBy(F.col("v").alias("id")).agg(F.sum("held").alias("part"))))
            given = level.join(arcs, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum((1 + F.col("held")) / F.col("paths")).alias("sent"))
            if len(sums) > 16:
                sums = [cut(reduce(DataFrame.unionByName, sums).groupBy("id").agg(F.sum("part").alias("part")))]
        del level, levels, reached, given
        release(spark)
    return reduce(DataFrame.unionByName, sums).groupBy("id").agg(F.sum("part").alias("part")) if sums else spark.createDataFrame([], "id long, part double")


def betweenness(names: DataFrame, links: DataFrame, sources: int = 256, held_links: int = HELD_LINKS) -> DataFrame:
    """(qualified_name, score): normalised betweenness over the undirected simple graph, from at most ``sources`` drawn names.

    Up to ``held_links`` links and names every task holds the graph as arrays of numbers; larger graphs are walked by joins.
    """
    spark = names.sparkSession
    names = cut(names.select("qualified_name", F.monotonically_increasing_id().alias("m")))
    counts = sorted((r["p"], r["count"]) for r in names.groupBy(F.shiftright("m", 33).alias("p")).count().collect())
    n = sum(c for _, c in counts)
    offsets = spark.createDataFrame([(p, sum(c for q, c in counts if q < p)) for p, _ in counts], "p long, first long")
    numbered = cut(names.join(F.broadcast(offsets), F.shiftright("m", 33) == F.col("p")).select("qualified_name", (F.col("first") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("id")))
    del names
    release(spark)
    end = lambda c, i: numbered.select(F.col("qualified_name").alias(c), F.col("id").alias(i))
    half = cut(links.where("src <> dst").join(end("src", "x"), "src").select("x", "dst"))  # numbers as soon as can be: names are long
    release(spark)
    pairs = cut(half.join(end("dst", "y"), "dst").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    del half
    release(spark)
    arcs = pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).union(pairs.select("y", "x"))
    k = n if n <= 200 else min(n, max(50, n // 10), sources)
    drawn = numbered.orderBy(F.md5("qualified_name"), "qualified_name").limit(k).select("id")
    if pairs.count() + n <= held_links:
        sums = _between_held(arcs, drawn, n)
    else:
        sums = _between_joined(arcs, [r["id"] for r in drawn.collect()], n)
    scale = 1.0 / ((n - 1) * (n - 2)) * n / max(k, 1) if n > 2 else 0.0
    return numbered.join(sums, "id", "left").select("qualified_name", (F.coalesce("part", F.lit(0.0)) * scale).alias("score"))


# Weights of the composite.
COMPOSITE = {"influence": 0.40, "bridge": 0.25, "closeness": 0.15, "eigenvector": 0.10, "fan_in": 0.10}


def centrality(nodes: DataFrame, edges: DataFrame, semantic_only: bool = True, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """All measures per ranked node and their composite; stability is in / (in + out + 1), volatility out / (in + out + 1)."""
    names, links = rankable(nodes, edges, semantic_only)
    names, links = cut(names), cut(links)
    score = lambda df, name: df.select("qualified_name", F.col("score").alias(name))
    degree = bridge(names, links)
    top = degree.agg(F.max("fan_in").alias("most"))
    joined = degree.withColumnRenamed("score", "bridge").crossJoin(F.broadcast(top))
    for measure in (score(pagerank(names, links, rounds=rounds, tolerance=tolerance), "influence"), score(closeness(names, links), "closeness"), score(eigenvector(names, links), "eigenvector")):
        joined = joined.join(measure, "qualified_name")
    linked = F.col("fan_in") + F.col("fan_out") + 1
    share = F.when(F.col("most") > 0, F.col("fan_in") / F.col("most")).otherwise(0.0)
    composite = COMPOSITE["influence"] * F.col("influence") + COMPOSITE["bridge"] * F.col("bridge") + COMPOSITE["closeness"] * F.col("closeness") + COMPOSITE["eigenvector"] * F.col("eigenvector") + COMPOSITE["fan_in"] * share
    return joined.select("qualified_name", "influence", "bridge", "closeness", "eigenvector", "fan_in", "fan_out", (F.col("fan_in") / linked).alias("stability"), (F.col("fan_out") / linked).alias("volatility"), composite.alias("composite"))


def top(scores: DataFrame, n: int = 20, order: str = "composite") -> DataFrame:
    """The n best by a measure, by hotspot (bridge + 0.01 * fan_in), stability or volatility; ties by name."""
    by = F.col("bridge") + 0.01 * F.col("fan_in") if order == "hotspot" else F.col(order)
    return scores.orderBy(by.desc(), "qualified_name").limit(n)


def personalised(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """(qualified_name, score): rank with teleport to the seeds that are nodes, to all nodes if none is.

    Edges weigh by kind, an unknown kind 0.1; edges to names that are no nodes take their share and lose it, which renormalising gives
    back to all every round.
    """
    names = nodes.select("qualified_name").distinct()
    weighed = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), weight_column(F.col("kind")).alias("w"))
    totals = weighed.groupBy("src").agg(F.sum("w").alias("total"))
    shares = weighed.groupBy("src", "dst").agg(F.sum("w").alias("w")).join(totals, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w"))
    known = names.select(F.col("qualified_name").alias("dst"))
    shares = shares.join(known, "dst", "left_semi").join(known.withColumnRenamed("dst", "src"), "src", "left_semi")
    valid = cut(seeds.select("qualified_name").distinct().join(names, "qualified_name", "left_semi"))
    k = valid.count()
    seats = valid.withColumn("seat", F.lit(1.0 / k)) if k else names.withColumn("seat", F.lit(1.0 / max(1, names.count())))
    return _power(names, shares, seats, alpha, rounds, tolerance, renormalise=True)


def fuse(ranked: DataFrame, edges: DataFrame, cosines: DataFrame | None = None, k: int = 50) -> DataFrame:
    """(qualified_name, ppr, semantic, structural, combined): .5 rank + .3 cosine + .2 fan-in, or .65, 0, .35 without cosines."""
    fan = edges.groupBy(F.col("target").alias("qualified_name")).agg(F.count("*").alias("n"))
    joined = ranked.withColumnRenamed("score", "ppr").join(fan, "qualified_name", "left")
    most = joined.agg(F.max("n").alias("most"))
    joined = joined.crossJoin(F.broadcast(most))
    if cosines is None:
        joined, weights = joined.withColumn("semantic", F.lit(0.0)), (0.65, 0.0, 0.35)
    else:
        joined, weights = joined.join(cosines.select("qualified_name", F.greatest("cosine", F.lit(0.0)).alias("semantic")), "qualified_name", "left"), (0.5, 0.3, 0.2)
    rows = joined.select("qualified_name", "ppr", F.coalesce("semantic", F.lit(0.0)).alias("semantic"), (F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce("most", F.lit(1)), F.lit(1))).alias("structural"))
    combined = weights[0] * F.col("ppr") + weights[1] * F.col("semantic") + weights[2] * F.col("structural")
    return rows.withColumn("combined", combined).orderBy(F.round("combined", 9).desc(), "qualified_name").limit(k)


def discrimination(ranked: DataFrame) -> DataFrame:
    """One row: spread of a score vector as deviation, entropy, greatest, least and their ratio."""
    p = F.col("score")
    row = ranked.agg(F.stddev_pop(p).alias("deviation"), (-F.sum(p * F.log(p + 1e-15))).alias("entropy"), F.max(p).alias("greatest"), F.min(p).alias("least"))
    return row
