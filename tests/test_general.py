"""Incremental capture, hierarchies and orphan references, with the odd cases each has to bear."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arbora.operators import hierarchy as H
from arbora.operators import increments as I
from arbora.operators import orphans as O

SYMBOLS = "qualified_name string, file_path string, mtime double, path string, offsets int"
FILES = "file_path string, mtime_ns long, size long, run_id long"
RUNS = "run_id long, status string"


def test_canonical_path(spark):
    given = ["a\\b\\c.py", "./a//b/./c.py", "a/x/../b/c.py", "../a", "/../a", "/a/", "", ".", None, "a/../.."]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(given)], "i int, p string")
    got = [r[0] for r in rows.orderBy("i").select(I.canonical_path(F.col("p"))).collect()]
    assert got == ["a/b/c.py", "a/b/c.py", "a/b/c.py", "../a", "/a", "/a", "", "", None, ".."]


def test_pending(spark):
    symbols = spark.createDataFrame(
        [("same", "a.py", 1.0, "x", 1), ("spelled", ".\\a.py", 1.0, "x", 1), ("changed", "b.py", 2.0, "x", 1), ("failed", "c.py", 3.0, "x", 1), ("old", "d.py", 4.0, "x", 1), ("zero", "e.py", 0.0, "x", 1), ("nopath", None, 1.0, "x", 1), ("nomtime", "a.py", None, "x", 1), ("changed", "b.py", 2.0, "x", 1), ("nan", "a.py", float("nan"), "x", 1)],
        SYMBOLS,
    )
    files = spark.createDataFrame([("a.py", 10**9, 1, 1), ("a.py", 10**9, 1, 1), ("b.py", 10**9, 1, 1), ("c.py", 3 * 10**9, 1, 2), ("d.py", 4 * 10**9, 1, 1), ("d.py", 5 * 10**9, 1, 3), ("e.py", 0, 1, 3), ("a.py", 7 * 10**9, 1, 9), (None, 1, 1, 1)], FILES)
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "ok"), (4, None)], RUNS)
    got = I.pending(symbols, files, runs)
    assert got.columns == symbols.columns
    assert sorted(r[0] for r in got.collect()) == ["changed", "changed", "failed", "nan", "nomtime", "nopath", "old"]
    assert sorted(r[0] for r in I.capture(symbols, files, runs).collect()) == ["changed", "failed", "nan", "nomtime", "nopath", "old"]
    assert I.pending(symbols.limit(0), files, runs).count() == 0
    assert I.pending(symbols, files.limit(0), runs.limit(0)).count() == 10


@pytest.mark.parametrize("folder", ["segments", "plans", "done"])
@pytest.mark.parametrize("when", ["before the rename", "after the rename"])
def test_killed_while_marking(spark, tmp_path, folder, when, monkeypatch):
    """Whatever is left when a driver dies around a marker, the next one takes everything once."""
    put = I.ChangeLog._put

    def dies(self, name, value):
        if name.startswith(folder + "/"):
            if when == "after the rename":
                put(self, name, value)
            else:
                self._fs.create(self._path(f"unfinished/{name.replace('/', '-')}"), True).close()
            raise KeyboardInterrupt
        put(self, name, value)

    symbols = spark.createDataFrame([("a", "x/../a.py", 1.0, "p", 1), ("b", "b.py", None, "p", 1), (None, None, 2.0, "p", 2), ("a", "a.py", 1.0, "p", 1)], SYMBOLS)
    files, runs = spark.createDataFrame([], FILES), spark.createDataFrame([], RUNS)
    monkeypatch.setattr(I.ChangeLog, "_put", dies)
    with pytest.raises(KeyboardInterrupt):
        I.capture(symbols, files, runs, str(tmp_path / "log"))
    monkeypatch.setattr(I.ChangeLog, "_put", put)
    for _ in range(2):
        got = I.capture(symbols, files, runs, str(tmp_path / "log"))
        assert got.columns == symbols.columns
        assert sorted(map(str, (r[0] for r in got.collect()))) == ["None", "a", "b"]


def test_change_log(spark, tmp_path):
    log = I.ChangeLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "qualified_name string, v int"))

    def fails(batch):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        log.run(fails)
    open_plan = log.plan()
    log.append(spark.createDataFrame([("a", 4), ("a", 4)], "qualified_name string, v int"))
    assert log.plan() == open_plan and log.batch(open_plan).count() == 3
    assert I.ChangeLog(spark, log.folder).run(lambda b: b.unionByName(b)) == open_plan  # repeated output is told apart by offset
    assert log.sink().count() == 3
    assert log.run(lambda b: b) is not None and log.sink().count() == 5
    assert log.run(lambda b: b) is None
    log.append(spark.createDataFrame([], "qualified_name string, v int"))
    assert log.plan() is None
    with pytest.raises(ValueError):
        log.append(spark.createDataFrame([(1,)], "_offset int"))


NODES = "qualified_name string, parent_qualified string, level int, size int"
TREE = [("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("c", "a"), ("lost", "nobody"), ("blank", "  "), ("x", "y"), ("y", "x"), ("self", "self"), ("z", "x"), ("zz", "z"), (None, "r")]


@pytest.mark.parametrize("local", [0, 4, 100])
def test_hierarchy(spark, local):
    nodes = spark.createDataFrame([(q, p, 1, 1) for q, p in TREE], NODES)
    assert sorted(r[0] for r in H.circular(nodes, local).collect()) == ["self", "x", "y"]
    rows = {r["id"]: r for r in H.hierarchy(nodes, local).collect()}
    assert len(rows) == 11
    assert rows["c"]["path"] == ["r", "a", "c"] and rows["c"]["depth"] == 2 and rows["c"]["root"] == "r" and rows["r"]["subtree"] == 4
    assert rows["lost"]["root"] == "lost" and rows["blank"]["depth"] == 0
    assert {q for q, r in rows.items() if r["state"] == "leads_to_circle"} == {"z", "zz"}
    assert rows["z"]["path"] is None and rows["x"]["state"] == "circle"
    below = {(r["id"], r["descendant"], r["distance"]) for r in H.descendants(H.hierarchy(nodes, local)).collect()}
    assert below == {("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("a", "c", 1)}
    assert H.hierarchy(nodes.limit(0), local).count() == 0 and H.circular(nodes.limit(0), local).count() == 0


def test_deep_chain(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, 1, 1) for i in range(3000)], NODES)
    row = H.hierarchy(nodes).agg(F.max("depth"), F.max("subtree")).first()
    assert tuple(row) == (2999, 3000)


def test_orphans(spark):
    day = lambda n: datetime(2030, 1, n)
    nodes = spark.createDataFrame([("a", day(5), None), ("a", day(5), None), ("gone", day(1), day(3)), ("gone", day(8), None), ("never", None, None), (None, day(1), None)], "qualified_name string, ingested_at timestamp, deleted_at timestamp")
    external = spark.createDataFrame([("lib",), (None,)], "symbol string")
    edges = spark.createDataFrame(
        [(1, "a", "lib", day(6)), (2, "a", "gone", day(5)), (2, "a", "gone", day(5)), (3, "gone", "gone", day(9)), (4, "a", None, day(4)), (5, "", " ", day(9)), (6, "a", "lib", None), (7, "never", "nobody", day(9))],
        "edge_id long, source string, target string, ingested_at timestamp",
    ).withColumn("h1", F.lit(0)).withColumn("side", F.lit("x"))
    for share in (0.001, 0.2, 2.0):
        got = sorted((r["edge_id"], r["side"]) for r in O.orphan_references(edges, nodes, external, share).collect())
        assert got == [(2, "target"), (4, "source"), (5, "target"), (6, "source"), (7, "source"), (7, "target")]
    report = {(r["side"], r["period"]): (r["refs"], r["orphans"]) for r in O.orphan_report(edges, nodes, external).collect()}
    assert report[("target", datetime(2030, 1, 1))] == (5, 3) and report[("source", None)] == (1, 1)
    assert O.orphan_references(edges.limit(0), nodes, external).count() == 0
    assert O.orphan_references(edges, nodes.limit(0), external.limit(0)).count() == 12


def test_long_chains_lead_to_circles(spark):
    """Chains far longer than the local bound: into a circle, into a root, and a node that is its own parent."""
    rows = [(f"a{i:04d}", f"a{i + 1:04d}") for i in range(700)] + [("a0700", "c0"), ("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("self", "self"), ("x", "self")] + [(f"b{i:04d}", f"b{i + 1:04d}") for i in range(700)] + [("b0700", None)]
    nodes = spark.createDataFrame(rows, "qualified_name string, parent_qualified string")
    for bound in (5, 10**6):
        assert {r[0] for r in H.circular(nodes, bound).collect()} == {"c0", "c1", "c2", "self"}
