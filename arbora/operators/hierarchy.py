"""Parent-child links to full hierarchies by bottom-up leaf peeling.

Round by round the nodes without children left are peeled off; each sends its subtree size to its parent. What can't be peeled
lies on a circle, since every node has at most one parent. In reverse peel order the parents hand path, depth and root down.
Once few enough nodes are left, one task of bounded size peels the rest, so that long chains don't cost a round each.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.session import cut

#: Links that one task may finish; a bound that doesn't depend on the data.
LOCAL_LINKS = 100_000


def parent_links(nodes: DataFrame, key: str = "qualified_name", parent: str = "parent_qualified") -> DataFrame:
    """(id, parent), one row per non-null key; parent is null if it is null, blank or no key.

    Rows of a key are taken to agree; should they not, the least parent counts.
    """
    rows = nodes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(F.when(F.trim(F.col(parent)) != "", F.col(parent))).alias("parent"))
    known = rows.select(F.col("id").alias("known"))
    return rows.join(known, F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("parent"))


def _finish(links: pd.DataFrame) -> pd.DataFrame:
    """The rest of the peeling over a bounded set of links: level and subtree size, level null on a circle."""
    ids = links["id"].tolist()
    size = dict(zip(ids, links["size"].tolist()))
    parent = {i: p for i, p in zip(ids, links["parent"].tolist()) if p is not None and p in size}
    children = dict.fromkeys(ids, 0)
    for p in parent.values():
        children[p] += 1
    level: dict[str, int] = {}
    now, at = [i for i in ids if not children[i]], int(links["level"].iloc[0]) if len(links) else 0
    while now:
        above = []
        for i in now:
            level[i] = at
            p = parent.get(i)
            if p is not None:
                size[p] += size[i]
                children[p] -= 1
                if not children[p]:
                    above.append(p)
        now, at = above, at + 1
    return pd.DataFrame({"id": ids, "parent": links["parent"], "size": [size[i] for i in ids], "level": pd.array([level.get(i) for i in ids], dtype="Int64")})


def peel(links: DataFrame, local_links: int = LOCAL_LINKS, least_part: float = 0.0) -> tuple[list[DataFrame], DataFrame]:
    """(peeled, rest): frames of (id, parent, size, level) in peel order; rest ends with those of null level, which lie on circles.

    size counts the node itself and all below it. Nodes that are single or have no children go in round 0. Should more than local_links
    links be left of which a round peels less than least_part, peeling ends there and the rest also holds what leads to circles or to
    long chains.
    """
    left = cut(links.select("id", "parent", F.lit(1).cast("long").alias("size")))
    count, level, peeled = left.count(), 0, []
    while count > local_links:
        parents = left.where(F.col("parent").isNotNull()).select(F.col("parent").alias("above")).distinct()
        marked = cut(left.join(parents, F.col("id") == F.col("above"), "left").select("id", "parent", "size", F.col("above").isNull().alias("leaf")))
        leaves = marked.where("leaf").select("id", "parent", "size", F.lit(level).cast("long").alias("level"))
        sent = leaves.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("to")).agg(F.sum("size").alias("got"))
        left = cut(marked.where("not leaf").join(sent, F.col("id") == F.col("to"), "left").select("id", "parent", (F.col("size") + F.coalesce("got", F.lit(0))).alias("size")))
        before, count = count, left.count()
        if count == before:
            break  # circles only
        peeled.append(leaves)
        level += 1
        if before - count < least_part * before:
            break
    schema = "id string, parent string, size long, level long"
    if count > local_links:
        return peeled, left.select("id", "parent", "size", F.lit(None).cast("long").alias("level"))
    rest = left.withColumn("level", F.lit(level).cast("long")).groupBy().applyInPandas(_finish, schema)
    return peeled, cut(rest)


def _ends_on_circles(links: DataFrame) -> DataFrame:
    """(id) of the nodes on circles: what all nodes reach in 2 ** k >= n steps, by k joins that double the steps."""
    jumps = cut(links.where(F.col("parent").isNotNull()).select("id", F.col("parent").alias("to")))
    for _ in range(max(1, jumps.count().bit_length())):
        jumps = cut(jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").select("id", F.col("then").alias("to")))
    return jumps.select(F.col("to").alias("id")).distinct()


def circular(nodes: DataFrame, local_links: int = LOCAL_LINKS, least_part: float = 0.05, **columns: str) -> DataFrame:
    """(id) of the nodes that are reached again by following parents from themselves.

    Leaves are peeled as long as a round takes least_part of what is left; long chains, of which it takes less, are told from circles
    by doubling steps, in as many rounds as the logarithm of their length.
    """
    _, rest = peel(parent_links(nodes, **columns), local_links, least_part)
    stuck = rest.where(F.col("level").isNull())
    return _ends_on_circles(stuck) if stuck.count() > local_links else stuck.select("id")


def _hand_down(rest: pd.DataFrame) -> pd.DataFrame:
    """Path, depth and root over a bounded set of nodes that holds every ancestor of its members."""
    rest = rest.sort_values("level", ascending=False, na_position="first")
    path: dict[str, list[str] | None] = {}
    for i, p, level in zip(rest["id"], rest["parent"], rest["level"]):
        if pd.isna(level):
            path[i] = None
        elif p is None:
            path[i] = [i]
        else:
            path[i] = None if path[p] is None else [*path[p], i]
    return rest.assign(path=[path[i] for i in rest["id"]])[["id", "parent", "size", "level", "path"]]


def hierarchy(nodes: DataFrame, local_links: int = LOCAL_LINKS, **columns: str) -> DataFrame:
    """(id, parent, root, depth, path, subtree, state), one row per key.

    path holds the keys from the root to the node, depth is 0 at a root, subtree counts the node and everything below it. state is
    ``tree``, ``circle`` for nodes on a circle or ``leads_to_circle`` for those below one; the latter two have null root, depth and
    path, a circle's subtree counts what hangs on the node besides the circle. Null, blank and unknown parents make a root; null keys
    are left out; an empty table gives an empty result.
    """
    peeled, rest = peel(parent_links(nodes, **columns), local_links)
    schema = "id string, parent string, size long, level long, path array<string>"
    if rest.where(F.col("level").isNotNull()).isEmpty():
        done = rest.withColumn("path", F.lit(None).cast("array<string>"))
    else:
        done = rest.groupBy().applyInPandas(_hand_down, schema)
    done = cut(done)
    parts = [done]
    for leaves in reversed(peeled):
        above = reduce(DataFrame.unionByName, parts).select(F.col("id").alias("above"), F.col("path").alias("above_path"))
        joined = leaves.join(above, F.col("parent") == F.col("above"), "left")
        own = F.array("id")
        path = F.when(F.col("parent").isNull(), own).otherwise(F.concat("above_path", own))
        parts.append(cut(joined.select("id", "parent", "size", "level", path.alias("path"))))
    state = F.when(F.col("level").isNull(), "circle").when(F.col("path").isNull(), "leads_to_circle").otherwise("tree")
    return reduce(DataFrame.unionByName, parts).select("id", "parent", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), "path", F.col("size").alias("subtree"), state.alias("state")).withColumn("depth", F.when(F.col("path").isNotNull(), F.col("depth")))


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant, distance): one row per node and node below it, from the paths of ``hierarchy``.

    Rows instead of a list per node, since one node may have a third of all others below it.
    """
    rows = tree.where(F.col("path").isNotNull()).select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "id"))
    return rows.where(F.col("at") < F.col("depth")).select("id", "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
