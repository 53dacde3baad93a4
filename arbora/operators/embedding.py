"""Vectors of nodes: texts, lexical and other providers, exact search, refresh."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import vectors as V
from arbora.functions.words import LEXICAL_STOP, embedding_text, lexical_tokens
from arbora.schema import SKIPPED_FOR_EMBEDDING
from arbora.session import cut

#: Query vectors that a search broadcasts, at most; more are taken in blocks.
BLOCK = 2_000


def embeddable(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("kind").isin(list(SKIPPED_FOR_EMBEDDING)))


def texts(nodes: DataFrame, signature: bool = False) -> DataFrame:
    """(qualified_name, text, file_path) of the nodes worth embedding."""
    return embeddable(nodes).select("qualified_name", embedding_text(signature).alias("text"), "file_path")


def token_weights(rows: DataFrame) -> DataFrame:
    """(qualified_name, token, weight) of (qualified_name, text): the weights before they are hashed into a vector."""
    tokens = rows.select("qualified_name", F.explode(lexical_tokens(F.col("text"))).alias("t"))
    return tokens.groupBy("qualified_name", "t.token").agg(F.sum("t.weight").alias("weight"))


def lexical_vector(text: str, dims: int) -> list[float]:
    """Words hashed into dims buckets by BLAKE2b, length 1 (all zero without words)."""
    import re

    vector = np.zeros(dims)
    for word in re.findall(r"[a-z0-9]+", text.lower()):
        if len(word) >= 2 and word not in LEXICAL_STOP:
            for token, weight in ((word, 1.0), ("~" + word[:5], 0.5 if len(word) > 5 else 0.0)):
                vector[int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little") % dims] += weight
    size = np.linalg.norm(vector)
    return (vector / size if size else vector).tolist()


Provider = Callable[[Iterator[list[str]]], Iterator[list[list[float]]]]


def lexical(dims: int = 1024) -> Provider:
    return lambda batches: ([lexical_vector(t, dims) for t in batch] for batch in batches)


def stub(dims: int = 64) -> Provider:
    return lambda batches: ([[0.0] * dims for _ in batch] for batch in batches)


PROVIDERS: dict[str, Callable[..., Provider]] = {"lexical": lexical, "stub": stub}


def provider(name: str, **options) -> Provider:
    """A registered provider; one that loads a model does so once a worker, before its first batch."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known are {sorted(PROVIDERS)}")
    return PROVIDERS[name](**options)


def embed(rows: DataFrame, how: Provider) -> DataFrame:
    """(qualified_name, text, vector, file_path): equal texts are embedded once and joined back by their hash."""

    def run(frames):
        for frame in frames:
            vector = next(iter(how(iter([frame["text"].tolist()]))))
            yield pd.DataFrame({"h": frame["h"], "vector": vector})

    keyed = rows.withColumn("h", F.sha2("text", 256))
    distinct = keyed.select("h", "text").dropDuplicates(["h"])
    made = distinct.mapInPandas(run, "h string, vector array<float>")
    return keyed.join(made, "h").select("qualified_name", "text", "vector", "file_path")


def refresh(stored: DataFrame, nodes: DataFrame, stale: DataFrame, how: Provider) -> DataFrame:
    """stored with the vectors of stale files' nodes made anew and those of removed files dropped; stale: (file_path, state)."""
    gone = stale.select("file_path").distinct()
    again = nodes.join(stale.where(F.col("state") != "removed").select("file_path").distinct(), "file_path", "left_semi")
    return stored.join(gone, "file_path", "left_anti").unionByName(embed(texts(again), how))


def search(stored: DataFrame, queries: DataFrame, k: int = 10, least: float = -1.0, key: str = "qualified_name", vector: str = "vector", exclude_self: bool = False) -> DataFrame:
    """(query, key, cosine, rank): the k most similar of all stored vectors for every query, exactly; ties by key.

    queries: (query, query_vector). They are broadcast in blocks of at most BLOCK, the stored vectors are read once a block and never
    shuffled; only each task's best k per query are. A zero query has cosine 0 with everything.
    """
    asked = cut(queries.select("query", F.col("query_vector").cast("array<double>").alias("qv")).where(F.col("qv").isNotNull()))
    blocks = max(1, -(-asked.count() // BLOCK))
    held = stored.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    held = held.withColumn("size", V.norm(F.col("v")))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        part = part.withColumn("qsize", V.norm(F.col("qv")))
        pairs = held.crossJoin(F.broadcast(part)).where(F.size("v") == F.size("qv"))
        if exclude_self:
            pairs = pairs.where(F.col(key) != F.col("query"))
        both = F.col("size") * F.col("qsize")
        scored = pairs.select("query", key, F.round(F.when(both > 0, V.dot(F.col("v"), F.col("qv")) / both).otherwise(0.0), 9).alias("cosine")).where(F.col("cosine") >= least)
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), key))).where(F.col("rank") <= k)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def spread(stored: DataFrame, sample: int = 500, key: str = "qualified_name", vector: str = "vector") -> DataFrame:
    """(pairs, mean, deviation) of the cosines between the ``sample`` rows with the least hash of their key, each pair once."""
    drawn = stored.select(F.col(key).cast("string").alias("k"), F.col(vector).cast("array<double>").alias("v")).orderBy(F.md5("k"), "k").limit(sample)
    a, b = drawn.select(F.col("k").alias("ka"), F.col("v").alias("va")), drawn.select(F.col("k").alias("kb"), F.col("v").alias("vb"))
    pairs = a.join(F.broadcast(b), F.col("ka") < F.col("kb"))
    c = V.cosine(F.col("va"), F.col("vb"))
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("deviation"))


def _centroids(unit: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Directions of the lists: spherical k-means from evenly drawn rows; a list that loses its members keeps its direction."""
    centroids = unit[np.linspace(0, len(unit) - 1, lists).astype(int)]
    for _ in range(rounds):
        own = np.argmax(unit @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def approximate(stored: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.95, key: str = "qualified_name", vector: str = "vector", exclude_self: bool = False, sample: int = 10_000, probes: int = 64) -> DataFrame:
    """(query, key, cosine, rank): about what ``search`` gives, from the stored vectors of the lists nearest to each query only.

    queries: (query, query_vector), in blocks as in ``search``; stored vectors aren't shuffled. Lists are fitted on ``sample`` vectors; as
    many are probed as hold the share ``recall`` of the true neighbours of ``probes`` queries. Queries that get fewer than k rows,
    and those of another length or all zero, are searched exactly.
    """
    asked = cut(queries.select("query", F.col("query_vector").cast("array<double>").alias("qv")).where(F.col("qv").isNotNull()))
    common = asked.groupBy(F.size("qv").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = common["n"] if common else 0
    usable = lambda v: V.usable(v, dims) & (V.norm(v) > 0)
    held = stored.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))
    drawn = [r["v"] for r in held.orderBy(F.xxhash64("v")).limit(sample).select("v").collect()]
    exact = lambda rows: search(stored, rows.withColumnRenamed("qv", "query_vector"), k, key=key, vector=vector, exclude_self=exclude_self)
    if not drawn:
        return exact(asked)
    norm = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    unit = norm(np.array(drawn))
    centroids = _centroids(unit, int(np.clip(np.sqrt(len(unit)), 1, 1024)))
    tried = asked.where(usable(F.col("qv"))).orderBy(F.xxhash64("query")).limit(probes)
    true = exact(tried).select("query", F.col(key).alias("key")).join(held, "key").join(tried, "query").select("v", "qv").collect()
    count = 1
    if true:
        own = np.argmax(norm(np.array([r["v"] for r in true])) @ centroids.T, axis=1)
        near = norm(np.array([r["qv"] for r in true])) @ centroids.T
        ranks = np.sort((near > near[np.arange(len(own)), own][:, None]).sum(1))
        count = int(ranks[int(np.ceil(recall * len(ranks))) - 1]) + 1
    schema = f"query {asked.schema['query'].dataType.simpleString()}, {key} {stored.schema[key].dataType.simpleString()}, cosine double"
    blocks, out = max(1, -(-asked.count() // BLOCK)), None
    for b in range(blocks):
        part = asked.where(usable(F.col("qv")) & (F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)).collect()
        if not part:
            continue
        directions = norm(np.array([r["qv"] for r in part]))
        probed = np.argsort(-(directions @ centroids.T), axis=1, kind="stable")[:, :count]
        shared = stored.sparkSession.sparkContext.broadcast(([r["query"] for r in part], directions, probed, centroids))

        def scan(frames):
            names, directions, probed, centroids = shared.value
            best = None
            for frame in frames:
                if frame.empty:
                    continue
                frame = frame.sort_values("key")
                unit = norm(np.array(frame["v"].tolist()))
                own, keys = np.argmax(unit @ centroids.T, axis=1), frame["key"].to_numpy()
                found = [] if best is None else [best]
                for c in np.unique(own):
                    q, m = np.flatnonzero((probed == c).any(1)), np.flatnonzero(own == c)
                    sims = np.round(directions[q] @ unit[m].T, 9)
                    top = np.argsort(-sims, axis=1, kind="stable")[:, : k + 1]
                    found.append(pd.DataFrame({"q": np.repeat(q, top.shape[1]), "key": keys[m[top]].reshape(-1), "cosine": np.take_along_axis(sims, top, 1).reshape(-1)}))
                both = pd.concat(found, ignore_index=True).sort_values(["q", "cosine", "key"], ascending=[True, False, True])
                best = both[both.groupby("q").cumcount() <= k]
            if best is not None:
                yield pd.DataFrame({"query": [names[i] for i in best["q"]], key: best["key"].to_numpy(), "cosine": best["cosine"].to_numpy()})

        rows = held.mapInPandas(scan, schema)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return exact(asked)
    if exclude_self:
        out = out.where(F.col(key) != F.col("query"))
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), key)
    ranked = cut(out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    full = ranked.where(F.col("rank") == k).select("query")
    return ranked.join(full, "query", "left_semi").select("query", key, "cosine", "rank").unionByName(exact(asked.join(full, "query", "left_anti")).select("query", key, "cosine", "rank"))
