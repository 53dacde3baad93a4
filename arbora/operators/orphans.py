"""References to records that do not exist.

Method: references are counted per key and period first; keys that hold very many references are checked against a broadcast of
their few records, all other keys by a shuffled anti join; both parts are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.session import cut

#: A key is heavy if it holds more than this share of all references; so there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.001
#: Heavy keys' records are broadcast only up to this many rows; beyond it they take the shuffled way as well.
BROADCAST_ROWS = 200_000


def _name(column: str) -> list:
    """A name as two independent 64-bit hashes, so that shuffles carry 16 bytes a row instead of the text.

    Two different names are taken for one only if both hashes agree, a chance of 2**-128 a pair.
    """
    return [F.xxhash64(column).alias("h1"), F.xxhash64(F.lit(7), column).alias("h2")]


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, side, h1, h2, at): both ends of every edge row, without null and empty ones."""
    ends = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("ref")) for s in ("source", "target")])
    rows = edges.select("edge_id", F.col("ingested_at").alias("at"), F.explode(ends).alias("end")).where((F.col("end.ref") != ""))
    return rows.select("edge_id", F.col("end.side").alias("side"), *_name("end.ref"), "at")


def lifetimes(nodes: DataFrame, external: DataFrame) -> DataFrame:
    """(n1, n2, born, died): the distinct spans in which a name may be referred to. External symbols exist at any time.

    Null born with null died means always; a node without ingested_at never exists and is left out.
    """
    own = nodes.where(F.col("qualified_name").isNotNull() & F.col("ingested_at").isNotNull()).select(*_name("qualified_name"), F.col("ingested_at").alias("born"), F.col("deleted_at").alias("died"))
    always = F.lit(None).cast("timestamp")
    known = external.where(F.col("symbol").isNotNull()).select(*_name("symbol"), always.alias("born"), always.alias("died"))
    return own.unionByName(known).distinct().withColumnsRenamed({"h1": "n1", "h2": "n2"})


def heavy_keys(refs: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(h1, h2, n) of the names that hold more than the share of all references, found in counts per name and month."""
    counts = refs.groupBy("h1", "h2", F.date_trunc("month", "at").alias("period")).agg(F.count("*").alias("n")).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") > F.col("total") * share).select("h1", "h2", "n")


def orphan_references(edges: DataFrame, nodes: DataFrame, external: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(edge_id, side, h1, h2, at) of the ends that name nothing that exists when the edge was ingested, one row each.

    A name exists at a time if external holds it, or if a nodes row of that name has ingested_at <= time and deleted_at null or
    later than the time. Null and empty ends are no references. An edge without a time refers to external symbols only. Repeated
    edge rows count once, empty tables give an empty result, further columns are ignored.
    """
    refs = references(edges)
    spans = lifetimes(nodes, external)
    # at most 1 / share rows by construction; cut, so that they are found once and both parts see the same
    heavy = cut(heavy_keys(refs, share).select(F.col("h1").alias("k1"), F.col("h2").alias("k2")))
    is_hot = F.broadcast(heavy), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    hot = spans.join(F.broadcast(heavy), (F.col("n1") == F.col("k1")) & (F.col("n2") == F.col("k2")), "left_semi")
    alive = (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")) & (F.col("born").isNull() | ((F.col("born") <= F.col("at")) & (F.col("died").isNull() | (F.col("at") < F.col("died")))))
    if heavy.isEmpty() or hot.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        bad = refs.join(spans, alive, "left_anti")
    else:
        of_hot = refs.join(*is_hot, "left_semi").join(F.broadcast(hot), alive, "left_anti")
        of_rest = refs.join(*is_hot, "left_anti").join(spans, alive, "left_anti")
        bad = of_hot.unionByName(of_rest)
    return bad.dropDuplicates(["edge_id", "side"])


def orphan_report(edges: DataFrame, nodes: DataFrame, external: DataFrame) -> DataFrame:
    """(side, period, refs, orphans, orphan_keys) per side and month of the edges; period is null for edges without a time."""
    period = F.date_trunc("month", "at").alias("period")
    total = references(edges).groupBy("side", "edge_id", period).agg(F.lit(1).alias("one")).groupBy("side", "period").agg(F.count("*").alias("refs"))
    # per name first, so that a name with very many orphans is one row before the names are counted
    bad = orphan_references(edges, nodes, external).groupBy("side", period, "h1", "h2").agg(F.count("*").alias("n")).groupBy("side", "period").agg(F.sum("n").alias("orphans"), F.count("*").alias("orphan_keys"))
    b = bad.select(F.col("side").alias("s"), F.col("period").alias("p"), "orphans", "orphan_keys")
    joined = total.join(b, (F.col("side") == F.col("s")) & F.col("period").eqNullSafe(F.col("p")), "left")
    return joined.select("side", "period", "refs", F.coalesce("orphans", F.lit(0)).alias("orphans"), F.coalesce("orphan_keys", F.lit(0)).alias("orphan_keys"))
