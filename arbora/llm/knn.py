"""The most similar vectors for every vector, by inverted lists of anisotropically quantised codes and exact reranking.

Plan: unit vectors, exact copies merged to one; a model fitted on a bounded sample; every vector coded and put in its list; the
number of lists to probe, and how far below the best a true neighbour's table score may be, measured against brute force on a bounded
set of queries; neighbouring lists' queries gathered in tasks of bounded size, which scan the codes of the probed lists by tables and
rerank all that score well enough by exact inner product. Tasks read the lists from files in the shared folder, written once: shuffled to
the tasks, each vector would lie on disk as often as its list is probed.

Where only neighbours of a least similarity are wanted, a query probes the lists whose border lies near enough, and of their codes only
those that score well enough for it are reranked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from arbora.llm import quantise
from arbora.session import cut, release, shared_folder, spread

#: Rows of a list's file, about; lists beyond it are written by several tasks.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """Parameters; all bounds are independent of the data's size.

    dims: components of a usable vector. list_size: vectors a coarse list should hold; max_lists bounds their number. sample:
    vectors the model is fitted on, at most. recall: the share of true neighbours that the probed lists must hold, and that must be
    among the candidates by table score, measured on probes queries. rerank: candidates a neighbour wanted, at least. task_queries,
    task_members: size of one task. grain: components that differ by less count as equal when copies are merged. digits: similarities
    equal to so many digits are ties. reach_queries, reach_pairs, reserve: as of ``reach``.
    """

    dims: int = 64
    list_size: int = 1000
    max_lists: int = 4096
    sample: int = 50_000
    recall: float = 0.985
    probes: int = 256
    rerank: int = 10
    task_queries: int = 8192
    task_members: int = 131_072
    grain: float = 1e-5
    digits: int = 6
    reach_queries: int = 4096
    reach_pairs: int = 256
    reserve: float = 1.5


def units(vectors: DataFrame, settings: Settings, name: str = "qualified_name", vector: str = "vector") -> DataFrame:
    """(name, unit, key): one row per name with a usable vector, unit its direction as float32 bytes, key equal for equal directions.

    Usable are vectors of ``dims`` finite components that aren't all zero; rows with a null name are left out. Should rows of one name
    disagree, the least vector counts.
    """
    dims, grain = settings.dims, settings.grain

    def convert(batches):
        for batch in batches:
            names, lists = batch.column(0), batch.column(1)
            width = np.array([0 if v is None else v for v in lists.value_lengths().to_pylist()]) if len(lists) else np.zeros(0, int)
            right = np.flatnonzero(width == dims)
            flat = np.asarray(lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
            good = np.isfinite(flat).all(1) & (flat != 0).any(1)
            right, flat = right[good], flat[good]
            flat /= np.abs(flat).max(1, keepdims=True) if len(flat) else 1.0
            flat /= np.linalg.norm(flat, axis=1, keepdims=True) if len(flat) else 1.0
            grid = np.rint(flat / grain).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(right)), pa.array([x.tobytes() for x in flat.astype(np.float32)], pa.binary()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in grid], pa.binary())],
                ["name", "unit", "key"],
            )

    rows = vectors.where(F.col(name).isNotNull() & (F.size(vector) == dims)).select(F.col(name).alias("name"), F.col(vector).cast("array<float>").alias("vector"))
    return rows.mapInArrow(convert, "name string, unit binary, key binary").groupBy("name").agg(F.min(F.struct("unit", "key")).alias("v")).select("name", "v.unit", "v.key")


def merge_copies(named: DataFrame, names: int) -> DataFrame:
    """(uid, key, unit, names, copies): one row per direction, with its ``names`` least names and the number of all; uid rises by name.

    The rank limit is applied before the shuffle, so a direction that a third of all rows share stays small.
    """
    counts = named.groupBy("key").agg(F.count("*").alias("copies"))
    least = named.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("name"))).where(F.col("rank") <= names)
    merged = least.groupBy("key").agg(F.min_by("unit", "name").alias("unit"), F.sort_array(F.collect_list("name")).alias("names"))
    groups = cut(merged.join(counts, "key").sort(F.element_at("names", 1)).withColumn("uid", F.monotonically_increasing_id()))
    del counts, least, merged
    release(named.sparkSession)
    return groups


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dims)


def fit(groups: DataFrame, count: int, settings: Settings) -> tuple[quantise.Model, np.ndarray]:
    """A model from at most ``sample`` directions, the least by a hash of their key, and about how many of all each list will hold."""
    rows = groups.select("unit", F.xxhash64("key").alias("h")).orderBy("h").limit(settings.sample).collect()
    lists = int(np.clip(count // settings.list_size, 1, settings.max_lists))
    unit = _matrix([r["unit"] for r in rows], settings.dims)
    model = quantise.train(unit, lists)
    return model, np.bincount(model.lists_of(unit), minlength=len(model.centroids)) * (count / len(unit))


def index(groups: DataFrame, model: quantise.Model) -> DataFrame:
    """(list, n, ids, codes, units): every direction, packed in blocks of one list as bytes."""
    shared = groups.sparkSession.sparkContext.broadcast(model)

    def blocks(frames):
        model = shared.value
        for frame in frames:
            for at in range(0, len(frame), 4096):
                rows = frame.iloc[at : at + 4096]
                unit = _matrix(rows["unit"], model.dims)
                own = model.lists_of(unit)
                codes = quantise.pack(quantise.encode(unit - model.centroids[own], unit, model.codebooks, model.eta))
                ids, order = rows["uid"].to_numpy(np.int64), np.argsort(own, kind="stable")
                out = []
                for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                    out.append((int(own[part[0]]), len(part), ids[part].tobytes(), codes[part].tobytes(), unit[part].tobytes()))
                yield pd.DataFrame(out, columns=["list", "n", "ids", "codes", "units"])

    return groups.select("uid", "unit").mapInPandas(blocks, "list int, n int, ids binary, codes binary, units binary")


def store(blocks: DataFrame, sizes: np.ndarray, folder: str) -> DataFrame:
    """The blocks, written to the folder with a folder of its own for every list; large lists are written by several tasks."""
    spark = blocks.sparkSession
    ways = F.lit(1)
    for c in np.flatnonzero(sizes > FILE_ROWS).tolist():
        ways = F.when(F.col("list") == c, F.lit(int(sizes[c] // FILE_ROWS) + 1)).otherwise(ways)
    placed = blocks.repartition(spread(blocks), "list", F.pmod(F.xxhash64("ids"), ways))
    placed.write.option("compression", "none").partitionBy("list").parquet(folder)
    del placed
    release(spark)
    return spark.read.parquet(folder).select(F.col("list").cast("int").alias("list"), "n", "ids", "codes", "units")


def _stored(folder: str, c: int, way: int, ways: int, columns: list[str], dims: int) -> list[np.ndarray]:
    """Ids of a list's members that are way modulo ways, and the columns asked for."""
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    out: list[list] = [[] for _ in range(1 + len(columns))]
    infos = files.get_file_info(pyarrow.fs.FileSelector(f"{root}/list={c}"))
    for path in sorted(i.path for i in infos if i.is_file and not i.base_name.startswith(("_", "."))):
        with files.open_input_file(path) as source:
            for batch in pyarrow.parquet.ParquetFile(source).iter_batches(64, columns=["ids", *columns]):
                raw = [b"".join(batch.column(name).to_pylist()) for name in ("ids", *columns)]
                ids = np.frombuffer(raw[0], np.int64)
                own = ids % ways == way
                parts = [ids, *(np.frombuffer(r, np.uint8).reshape(-1, dims // 4) if name == "codes" else np.frombuffer(r, np.float32).reshape(-1, dims) for name, r in zip(columns, raw[1:]))]
                for held, part in zip(out, parts):
                    held.append(part[own] if ways > 1 else part)
    empty = [np.empty(0, np.int64), *(np.empty((0, dims // 4), np.uint8) if name == "codes" else np.empty((0, dims), np.float32) for name in columns)]
    return [np.concatenate([e, *held]) for e, held in zip(empty, out)]


def brute_force(blocks: DataFrame, queries: list[tuple[int, bytes]], k: int, dims: int) -> pd.DataFrame:
    """(query, uid, list, sim): exact k nearest of a bounded number of queries among all vectors, themselves left out."""
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def best(frames):
        ids = np.array([i for i, _ in shared.value], np.int64)
        asked = _matrix([u for _, u in shared.value], dims)
        every = np.arange(len(ids))[:, None]
        held = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -9, np.float32), np.full((len(ids), k), -1, np.int32)
        for frame in frames:
            uid, lists = np.frombuffer(b"".join(frame["ids"]), np.int64), np.repeat(frame["list"].to_numpy(np.int32), frame["n"])
            units = _matrix(frame["units"], dims)
            for at in range(0, len(uid), 8192):
                part, own = uid[at : at + 8192], lists[at : at + 8192]
                sims = asked @ units[at : at + 8192].T
                sims[ids[:, None] == part[None]] = -9
                top = np.argpartition(-sims, min(k, sims.shape[1] - 1), axis=1)[:, :k]
                u, s, c = np.c_[held[0], part[top]], np.c_[held[1], sims[every, top]], np.c_[held[2], own[top]]
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                held = u[every, top], s[every, top], c[every, top]
        yield pd.DataFrame({"query": np.repeat(ids, k), "uid": held[0].reshape(-1), "list": held[2].reshape(-1), "sim": held[1].reshape(-1)})

    rows = blocks.select("list", "n", "ids", "units").mapInPandas(best, "query long, uid long, list int, sim float").where("sim > -2")
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "uid")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank").toPandas()


def probe_order(model: quantise.Model) -> np.ndarray:
    """(lists, lists): for each list all lists, the nearest first, itself ahead."""
    near = model.centroids @ model.centroids.T
    np.fill_diagonal(near, 9)
    return np.argsort(-near, axis=1, kind="stable")


def probe_count(groups: DataFrame, blocks: DataFrame, model: quantise.Model, k: int, settings: Settings) -> int:
    """The least number of lists to probe so that they hold the wanted share of the true neighbours of ``probes`` queries."""
    rows = groups.select("uid", "unit", F.xxhash64("key", F.lit("probe")).alias("h")).orderBy("h").limit(settings.probes).collect()
    if not rows:
        return 1
    own = model.lists_of(_matrix([r["unit"] for r in rows], model.dims))
    truth = brute_force(blocks, [(r["uid"], bytes(r["unit"])) for r in rows], k, model.dims)
    rank = np.argsort(probe_order(model), axis=1)
    at = {r["uid"]: c for r, c in zip(rows, own)}
    ranks = np.sort([rank[at[q], c] for q, c in zip(truth["query"], truth["list"])])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(settings.recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def score_slack(blocks: DataFrame, groups: DataFrame, model: quantise.Model, k: int, settings: Settings) -> float:
    """How far below the keep-th best table score candidates are taken, so that they hold the wanted share of the true neighbours.

    Near-copies share codes or differ in few, so that their scores say little about their order; where they are many, this takes them
    all. 0 where the keep best hold enough. Measured over all lists, which is no less than over the probed ones.
    """
    rows = groups.select("uid", "unit", F.xxhash64("key", F.lit("slack")).alias("h")).orderBy("h").limit(settings.probes).collect()
    truth = brute_force(blocks, [(r["uid"], bytes(r["unit"])) for r in rows], k, model.dims)
    if not len(truth):
        return 0.0
    keep, asked = settings.rerank * k + 1, _matrix([r["unit"] for r in rows], model.dims)
    number = {r["uid"]: i for i, r in enumerate(rows)}
    wanted = truth["query"].map(number).to_numpy(np.int64), truth["uid"].to_numpy(np.int64)
    shared = blocks.sparkSession.sparkContext.broadcast((model, asked, wanted))

    def measure(frames):
        model, asked, (true_query, true_uid) = shared.value
        lut, scale = quantise.tables(asked, model)
        base = quantise.bases(asked, model, np.arange(len(model.centroids)), scale)
        top = np.empty((0, len(asked)), np.int16)
        by_uid = np.argsort(true_uid, kind="stable")
        for frame in frames:
            uid, lists = np.frombuffer(b"".join(frame["ids"]), np.int64), np.repeat(frame["list"].to_numpy(np.int32), frame["n"])
            codes = np.frombuffer(b"".join(frame["codes"]), np.uint8).reshape(-1, model.dims // 4)
            for at in range(0, len(uid), 2048):
                score = quantise.scores(lut, base[lists[at : at + 2048]], codes[at : at + 2048])
                low, high = (np.searchsorted(true_uid, uid[at : at + 2048], side, by_uid) for side in ("left", "right"))
                row = np.repeat(np.arange(len(low)), high - low)
                if len(row):
                    t = by_uid[np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
                    yield pd.DataFrame({"query": true_query[t], "true": True, "score": score[row, true_query[t]].astype(np.int64)})
                top = np.concatenate([top, score])
                top = np.partition(top, max(0, len(top) - keep), axis=0)[-keep:]
        yield pd.DataFrame({"query": np.tile(np.arange(len(asked)), len(top)), "true": False, "score": top.reshape(-1).astype(np.int64)})

    rows = cut(blocks.select("list", "n", "ids", "codes").mapInPandas(measure, "query long, true boolean, score long"))
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    kept = rows.where("not true").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    floors = kept.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == keep)
    gaps = np.sort([r["gap"] for r in rows.where("true").join(floors, "query").select((F.col("floor") - F.col("score")).alias("gap")).collect()])
    missed = len(truth) - int(np.ceil(settings.recall * len(truth)))  # neighbours that may be missed
    gap = float(gaps[len(gaps) - 1 - missed]) if len(gaps) > missed else 0.0
    return max(0.0, gap) / quantise.tables(asked, model)[1]


def nearest(query: np.ndarray, own: np.ndarray, ids: np.ndarray, units: np.ndarray, passing, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, members, sims) of the exact k best per query among the passing members, block by block with running best.

    Order: falling similarity, to ``digits`` digits, then rising id. A block of which many pass is multiplied as a whole.
    """
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids)] = np.arange(len(ids))
    query, unit = query.astype(np.float64), 10.0**digits
    key, member, value = np.full((len(query), k), -1, np.int64), np.zeros((len(query), k), np.int64), np.zeros((len(query), k))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    every = np.arange(len(query))[:, None]

    def keys(sims, m):
        return ((np.rint(sims * unit) + unit + 1).astype(np.int64) << 31) - place[m] + (1 << 31)

    def settle():
        q, m = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        other = ids[m] != own[q]
        q, m = q[other], m[other]
        sims = np.einsum("ij,ij->i", query[q], units[m].astype(np.float64))
        old = np.nonzero(key >= 0)
        q, m, s, x = np.r_[q, old[0]], np.r_[m, member[old]], np.r_[sims, value[old]], np.r_[keys(sims, m), key[old]]
        best = np.lexsort((-x, q))
        q, m, s, x = q[best], m[best], s[best], x[best]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        at = q[top], rank[top]
        key[at], member[at], value[at] = x[top], m[top], s[top]

    n = 0
    for at, mask in passing:
        amount = np.count_nonzero(mask)
        if 16 * amount > mask.size:
            m = np.arange(at, at + len(mask))
            sims = query @ units[m].astype(np.float64).T
            x = keys(sims, m[None])
            x[own[:, None] == ids[m][None]] = -1
            x, m, s = np.c_[key, x], np.c_[member, np.broadcast_to(m, sims.shape)], np.c_[value, sims]
            top = np.argpartition(-x, k - 1, axis=1)[:, :k]
            key[:], member[:], value[:] = x[every, top], m[every, top], s[every, top]
        elif amount:
            m, q = np.nonzero(mask)
            waiting.append((q, m + at))
            n += amount
            if n > 1 << 18:
                settle()
                n = 0
    if waiting:
        settle()
    order = np.argsort(-key, axis=1, kind="stable")
    held = key[every, order] >= 0
    return held.sum(1), member[every, order][held], value[every, order][held]


def plan_groups(sizes: dict[int, int], order: np.ndarray, probes: int, settings: Settings) -> list[tuple[list[int], int, int]]:
    """(lists, q_ways, m_ways) per group of lists that lie close together, taken until it has enough queries.

    A group with too many queries goes to q_ways tasks, and a task takes its members, all lists that it probes, in m_ways parts, so that
    none holds a hot list as a whole. The groups name each list once.
    """
    left, groups = {c for c in sizes if sizes[c]}, []
    for first in sorted(left):
        if first not in left:
            continue
        own, total = [], 0
        for c in map(int, order[first]):
            if c in left and (not own or total + sizes[c] <= settings.task_queries):
                own.append(c)
                total += sizes[c]
                left.discard(c)
            elif c in left:
                break
        needed = {int(c) for g in own for c in order[g][:probes] if sizes.get(int(c))}
        groups.append((own, -(-total // (2 * settings.task_queries)), -(-sum(sizes[c] for c in needed) // settings.task_members)))
    return groups


def _better(old: tuple, new: tuple, k: int, digits: int) -> tuple:
    """The k best of two (query, uid, sim), by falling similarity to the digits and rising uid; rows are ordered by query."""
    q, u, s = (np.concatenate(x) for x in zip(old, new))
    order = np.lexsort((u, -np.rint(s * 10.0**digits), q))
    q, u, s = q[order], u[order], s[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], u[top], s[top]


def neighbours(spark: SparkSession, folder: str, sizes: dict[int, int], model: quantise.Model, k: int, probes: int, slack: float, settings: Settings, parts: int) -> DataFrame:
    """(uid, near): near is an array of (sim, uid) of the k most similar other directions, by falling sim to the settings' digits and rising uid.

    A row of the plan is a task's share of a group. Nothing is shuffled: a task reads its queries and members from the folder of ``store``.
    """
    order = probe_order(model)
    groups = plan_groups(sizes, order, probes, settings)
    tasks = [(g, way) for g, (_, ways, _) in enumerate(groups) for way in range(ways)]
    shared = spark.sparkContext.broadcast((model, order[:, :probes], groups, set(sizes)))

    def one(group: int, way: int) -> tuple:
        model, lists, groups, filled = shared.value
        own, q_ways, m_ways = groups[group]
        asked = {c: _stored(folder, c, way, q_ways, ["units"], model.dims) for c in own}
        first = dict(zip(own, np.cumsum([0, *(len(ids) for ids, _ in asked.values())])))
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for m_way in range(m_ways):
            store = {}
            for c in sorted({int(x) for c in own for x in lists[c] if int(x) in filled}):
                ids, codes, units = _stored(folder, c, m_way, m_ways, ["codes", "units"], model.dims)
                if len(ids):
                    store[c] = ids, codes, units
            got = []
            for c, (ids, units) in asked.items():
                chosen = [int(x) for x in lists[c] if int(x) in store]
                if not chosen:
                    continue
                all_ids, all_units = np.concatenate([store[x][0] for x in chosen]), np.concatenate([store[x][2] for x in chosen])
                for at in range(0, len(ids), 256):
                    query = units[at : at + 256]
                    passing = quantise.passing(query, model, [(x, store[x][1]) for x in chosen], settings.rerank * k + 1, slack)
                    n, m, sims = nearest(query, ids[at : at + 256], all_ids, all_units, passing, k, settings.digits)
                    got.append((np.repeat(np.arange(len(n)) + at + first[c], n), all_ids[m], sims))
            if got:
                new = tuple(np.concatenate(x) for x in zip(*got))
                best = new if m_ways == 1 else _better(best, new, k, settings.digits)
        return np.concatenate([ids for ids, _ in asked.values()]), *best

    return _searched(spark, tasks, one, parts)


def _searched(spark: SparkSession, tasks: list[tuple[int, int]], one, parts: int) -> DataFrame:
    """(uid, near) of all tasks; one(group, way) gives the ids of a task's queries and rows of (query, uid, sim) in order."""

    def search(frames):
        for frame in frames:
            for group, way in zip(frame["group"], frame["way"]):
                ids, q, near, sims = one(group, way)
                ends = np.searchsorted(q, np.arange(1, len(ids)))
                for at in range(0, len(ids), 4096):
                    cuts = ends[at : at + 4095]
                    low, high = (ends[at - 1] if at else 0), (ends[at + 4095] if at + 4096 < len(ids) else len(q))
                    split = lambda x: np.split(x[low:high], cuts[: min(4096, len(ids) - at) - 1] - low)  # noqa: B023, E731
                    yield pd.DataFrame({"uid": ids[at : at + 4096], "near": split(near), "sim": split(sims.astype(np.float32))})

    planned = spark.createDataFrame(spark.sparkContext.parallelize(tasks, min(len(tasks), 8 * parts)), "group long, way long")
    rows = planned.mapInPandas(search, "uid long, near array<long>, sim array<float>")
    return cut(rows).select("uid", F.arrays_zip("sim", "near").alias("near"))  # as two arrays it is half as large


def reach(groups: DataFrame, blocks: DataFrame, model: quantise.Model, least: float, settings: Settings) -> tuple[float, float]:
    """(margin, gap) within which the neighbours of at least ``least`` lie.

    margin: how far, at most, a query lies from the border of a list that holds such a neighbour, the border being the points that
    are as close to that list's centroid as to its own list's. gap: how far the score of the neighbour's code is below its similarity,
    at most. Both are measured on ``reach_queries`` queries against all vectors and taken ``reserve`` times. No margin is above the sine of
    the angle of ``least``; where fewer than ``reach_pairs`` neighbours were met, that margin and no bound of the score are taken.
    """
    limit = float(np.sqrt(1 - least**2)) if least > 0 else 2.0
    rows = groups.select("uid", "unit", F.xxhash64("key", F.lit("reach")).alias("h")).orderBy("h").limit(settings.reach_queries).collect()
    shared = blocks.sparkSession.sparkContext.broadcast((model, np.array([r["uid"] for r in rows], np.int64), _matrix([r["unit"] for r in rows], model.dims)))

    def measure(frames):
        model, ids, asked = shared.value
        own, met, margin, gap = model.lists_of(asked), 0, 0.0, 0.0
        for frame in frames:
            for c, raw, codes, units in zip(frame["list"], frame["ids"], frame["codes"], frame["units"]):
                uid, unit = np.frombuffer(raw, np.int64), _matrix([units], model.dims)
                coded = model.centroids[c] + quantise.decode(np.frombuffer(codes, np.uint8).reshape(len(uid), -1), model)
                border = model.centroids[own] - model.centroids[c]
                far = np.einsum("ij,ij->i", asked, border) / np.maximum(np.linalg.norm(border, axis=1), 1e-9)
                for at in range(0, len(uid), 512):
                    sims = asked @ unit[at : at + 512].T
                    q, m = np.nonzero(sims >= least - 1e-6)
                    other = ids[q] != uid[m + at]
                    q, m = q[other], m[other]
                    met += len(q)
                    margin = max(margin, float(far[q].max(initial=0.0)))
                    for low in range(0, len(q), 1 << 16):
                        i, j = q[low : low + (1 << 16)], m[low : low + (1 << 16)]
                        gap = max(gap, float((sims[i, j] - np.einsum("ij,ij->i", asked[i], coded[j + at])).max()))
        yield pd.DataFrame({"met": [met], "margin": [margin], "gap": [gap]})

    found = blocks.select("list", "ids", "codes", "units").mapInPandas(measure, "met long, margin double, gap double")
    told = found.agg(F.sum("met").alias("met"), F.max("margin").alias("margin"), F.max("gap").alias("gap")).first()
    if (told["met"] or 0) < settings.reach_pairs:
        return limit, 3.0
    return min(limit, settings.reserve * told["margin"]), settings.reserve * told["gap"]


def close_neighbours(spark: SparkSession, folder: str, sizes: dict[int, int], model: quantise.Model, k: int, least: float, margin: float, gap: float, settings: Settings, parts: int) -> DataFrame:
    """As ``neighbours``, but only those of at least ``least``, within the bounds of ``reach``; every query probes lists of its own.

    A task takes list after list, in parts of at most ``task_members``, with those of its queries that probe it.
    """
    groups = plan_groups(sizes, probe_order(model), 1, settings)
    tasks = [(g, way) for g, (_, ways, _) in enumerate(groups) for way in range(ways)]
    shared = spark.sparkContext.broadcast((model, groups, sizes))

    def one(group: int, way: int) -> tuple:
        model, groups, sizes = shared.value
        own, q_ways, _ = groups[group]
        asked = [_stored(folder, c, way, q_ways, ["units"], model.dims) for c in own]
        ids, units = np.concatenate([i for i, _ in asked]), np.concatenate([u for _, u in asked])
        wide, asks, first = units.astype(np.float64), [], 0
        for c, (held, part) in zip(own, asked):
            reached = margin * np.linalg.norm(model.centroids - model.centroids[c], axis=1) + 1e-6
            for at in range(0, len(held), 1024):
                near = part[at : at + 1024] @ model.centroids.T
                q, x = np.nonzero(near[:, c, None] - near <= reached)
                asks.append((q + first + at, x))
            first += len(held)
        query, probed = (np.concatenate(x) for x in zip(*asks))
        order = np.argsort(probed, kind="stable")
        query, probed = query[order], probed[order]
        best, waiting, n = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], 0
        for q, c in zip(np.split(query, np.flatnonzero(np.diff(probed)) + 1), np.unique(probed).tolist()):
            ways = -(-sizes.get(c, 0) // settings.task_members)
            for m_way in range(ways):
                for at_q, at_m, sims in _close(q, ids, units, wide, *_stored(folder, c, m_way, ways, ["codes", "units"], model.dims), model, c, k, least, gap, settings.digits):
                    waiting.append((at_q, at_m, sims))
                    n += len(at_q)
                    if n > 1 << 18:
                        best, waiting, n = _better(best, tuple(np.concatenate(x) for x in zip(*waiting)), k, settings.digits), [], 0
        return ids, *_better(best, tuple(np.concatenate(x) for x in zip(*waiting)) if waiting else best, k, settings.digits)

    return _searched(spark, tasks, one, parts)


def _close(q, ids, units, wide, uids, codes, members, model: quantise.Model, c: int, k: int, least: float, gap: float, digits: int):
    """(query, uid, sim) of the queries q and one list's members, at least ``least`` alike, a block at a time; of a block of which many pass k a query at least."""
    order = np.argsort(uids)
    uids, codes, members = uids[order], codes[order], members[order]
    for at in range(0, len(uids), 4096):
        uid, exact = uids[at : at + 4096], members[at : at + 4096].astype(np.float64)
        coded = (model.centroids[c] + quantise.decode(codes[at : at + 4096], model)).T.copy()
        for low in range(0, len(q), 1024):
            own = q[low : low + 1024]
            mask = units[own] @ coded >= least - gap - 1e-6
            amount = np.count_nonzero(mask)
            if 16 * amount > mask.size:
                sims = wide[own] @ exact.T
                sims[ids[own][:, None] == uid[None]] = -9
                m = np.broadcast_to(np.arange(len(uid)), sims.shape)
                if len(uid) > k:
                    key = (np.rint(sims * 10.0**digits).astype(np.int64) << 12) - m
                    m = np.argpartition(-key, k - 1, axis=1)[:, :k]
                a, m, sims = np.repeat(own, m.shape[1]), m.reshape(-1), np.take_along_axis(sims, m, 1).reshape(-1)
            elif amount:
                a, m = np.nonzero(mask)
                a = own[a]
                other = ids[a] != uid[m]
                a, m = a[other], m[other]
                sims = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", wide[a[i : i + 65536]], exact[m[i : i + 65536]]) for i in range(0, len(a), 65536))])
            else:
                continue
            close = sims >= least - 1e-6
            yield a[close], uid[m[close]], sims[close]


@dataclass
class Search:
    """What a search leaves: the merged directions, their blocks (made anew when asked for), the model, the lists probed (0 if by a least similarity), and near as of ``neighbours``."""

    named: DataFrame
    groups: DataFrame
    blocks: DataFrame
    model: quantise.Model | None
    probes: int
    near: DataFrame


def search(vectors: DataFrame, k: int = 10, settings: Settings = Settings(), least: float | None = None, **columns: str) -> Search:
    """The k most similar directions of every direction, or those of them at least ``least`` alike. No usable vector gives an empty result."""
    named = units(vectors, settings, **columns)
    groups = merge_copies(named, k + 1)
    count = groups.count()
    if not count:
        empty = groups.select("uid", F.expr("cast(array() as array<struct<sim:float,near:bigint>>)").alias("near"))
        return Search(named, groups, groups, None, 0, empty)
    model, expected = fit(groups, count, settings)
    blocks = index(groups, model)
    with shared_folder(groups.sparkSession) as folder:
        stored = store(blocks, expected, folder)
        sizes = {r["list"]: r["n"] for r in stored.groupBy("list").agg(F.sum("n").alias("n")).collect()}
        if least is not None:
            near = close_neighbours(groups.sparkSession, folder, sizes, model, k, least, *reach(groups, stored, model, least, settings), settings, spread(groups))
            return Search(named, groups, blocks, model, 0, near)
        probes = probe_count(groups, stored, model, k, settings)
        slack = score_slack(stored, groups, model, k, settings)
        near = neighbours(groups.sparkSession, folder, sizes, model, k, probes, slack, settings, spread(groups))
    return Search(named, groups, blocks, model, probes, near)


def similar_names(found: Search, k: int = 10, least: float = -1.0) -> DataFrame:
    """(name_a, name_b, sim), name_a < name_b: one of the two is among the k most similar of the other, and sim is at least ``least``.

    Copies are at similarity 1; similarities equal to six digits are ordered by name. A name in a large group of copies has its k
    partners there or in near-copies of less name, so the rows grow with the names, not with the pairs.
    """
    lists = found.groups.select("uid", "key", "names", "copies")
    near = found.near.select("uid", F.explode("near").alias("n")).select("uid", "n.sim", F.col("n.near").alias("other")).where(F.col("sim") >= least)
    theirs = lists.select(F.col("uid").alias("other"), F.col("names").alias("other_names"))
    per = near.join(theirs, "other").groupBy("uid").agg(F.collect_list(F.struct("sim", F.col("other_names").alias("names"))).alias("l"))
    offer = lambda sim, name: F.struct((-F.round(sim.cast("double"), 6)).alias("order"), name.alias("name"), sim.cast("float").alias("sim"))
    offered = F.flatten(F.transform("l", lambda x: F.transform(x["names"], lambda y: offer(x["sim"], y))))
    twins = F.when(F.col("copies") > 1, F.transform("names", lambda y: offer(F.lit(1.0), y)))
    all_offers = F.array_sort(F.concat(*[F.coalesce(x, F.array().cast("array<struct<order:double,name:string,sim:float>>")) for x in (offered, twins)]))
    offers = cut(lists.join(per, "uid", "left").select("key", "names", "copies", F.slice(all_offers, 1, k + 1).alias("offered")))
    alone = offers.where(F.col("copies") <= k).select(F.explode("names").alias("name"), "offered")
    many = offers.where(F.col("copies") > k).select("key", "offered")
    # the names of the others are all in names, so that the vectors needn't be read again where no direction has more
    held = alone if many.isEmpty() else alone.unionByName(found.named.select("name", "key").join(many, "key").select("name", "offered"))
    others = F.slice(F.filter("offered", lambda o: o["name"] != F.col("name")), 1, k)
    both = held.select("name", F.explode(others).alias("o")).select("name", F.col("o.name").alias("other"), F.col("o.sim").alias("sim"))
    return both.select(F.least("name", "other").alias("name_a"), F.greatest("name", "other").alias("name_b"), "sim").dropDuplicates(["name_a", "name_b"])


def recall(found: Search, k: int = 10, probes: int = 200) -> DataFrame:
    """(queries, wanted, hit, recall) of the search against brute force, on ``probes`` directions drawn by a hash."""
    spark = found.groups.sparkSession
    rows = found.groups.select("uid", "unit", F.xxhash64("key", F.lit("recall")).alias("h")).orderBy("h").limit(probes).collect()
    truth = brute_force(found.blocks, [(r["uid"], bytes(r["unit"])) for r in rows], k, found.model.dims)
    wanted = spark.createDataFrame(truth[["query", "uid"]].rename(columns={"query": "asked", "uid": "true"}), "asked long, true long")
    got = found.near.join(F.broadcast(wanted.select(F.col("asked").alias("uid")).distinct()), "uid").select(F.col("uid").alias("asked"), F.explode("near").alias("n")).select("asked", F.col("n.near").alias("true"))
    hits = wanted.join(got, ["asked", "true"]).count()
    return spark.createDataFrame([(len(rows), len(truth), hits, hits / max(1, len(truth)))], "queries long, wanted long, hit long, recall double")
