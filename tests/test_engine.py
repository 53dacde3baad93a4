"""Saved state, refresh, snapshot, export and the stream."""

import os

import pytest
from pyspark.sql import functions as F

from arbora.engine import Engine, StateError, load_snapshot
from arbora.sources import config, scip, walk
from arbora.streaming.refresh import LiveGraph, windowed_counts


def write(root, **files):
    for name, text in files.items():
        (root / f"{name}.py").write_text(text)


def test_state(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    write(root, service="def login(u):\n    return check(u)\ndef check(u):\n    return u\n", app="from service import login\ndef main():\n    login(1)\n")
    (root / "bad.txt").write_text("no source")
    files = walk.read_folder(spark, str(root))
    assert sorted(r["file_path"] for r in files.collect()) == ["app.py", "service.py"]
    engine = Engine.build(files, config.Config(embedding_dimensions=64))
    engine.save(str(tmp_path / "state"))
    opened = Engine.open(spark, str(tmp_path / "state"))
    assert {r["qualified_name"] for r in opened.impact("login").collect()} == {"main"}
    assert opened.retrieve("login check").count() > 0 and "login" in opened.context("login").first()[0]
    assert opened.top_nodes(3).count() == 3
    same, stale = opened.refresh(walk.read_folder(spark, str(root)))
    assert same is opened and stale.count() == 0
    write(root, service="def login(u):\n    return u\ndef logout(u):\n    return login(u)\n")
    os.utime(root / "service.py", (1, 1))
    fresh, stale = opened.refresh(walk.read_folder(spark, str(root)))
    assert [r["state"] for r in stale.collect()] == ["changed"]
    assert {r["qualified_name"] for r in fresh.impact("login").where("direct").collect()} == {"main", "logout"}
    assert fresh.nodes.where("qualified_name = 'check'").count() == 0
    fresh.snapshot(str(tmp_path / "snap"))
    nodes, edges, _ = load_snapshot(spark, str(tmp_path / "snap"))
    assert nodes.count() == fresh.nodes.count() and edges.exceptAll(fresh.edges.select(*edges.columns)).count() == 0
    fresh.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "metadata")).first()["node_count"] == fresh.nodes.count()
    with pytest.raises(StateError):
        Engine.open(spark, str(tmp_path / "nothing"))


def test_config(capsys):
    made = config.from_mapping(config.parse("languages: [python, go]\nuse_louvain: true\ntop_k: 7\nwhat: 1\nexclude_paths:\n  - a\n  - b\n"))
    assert made.languages == ("python", "go") and made.use_louvain and made.top_k == 7 and made.exclude_paths == ("a", "b")
    assert "what" in capsys.readouterr().err


def test_scip(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"documents": [{"relativePath": "a.py", "language": "python", "symbols": [{"symbol": "s", "displayName": "", "kind": 17}], "occurrences": [{"range": [0, 4, 5], "symbol": "s", "symbolRoles": 1}, {"range": [3, 0, 2], "symbol": "s", "symbolRoles": 8}, {"range": [4, 0, 2], "symbol": "s"}]}], "externalSymbols": [{"symbol": "x", "kind": 7}]}')
    symbols, occurrences = scip.read(spark, str(tmp_path / "i.json"))
    assert {(r["qualified_name"], r["kind"]) for r in symbols.collect()} == {("s", "Function"), ("x", "Class")}
    assert sorted((r["line"], r["role"]) for r in occurrences.collect()) == [(1, "definition"), (4, "write"), (5, "reference")]
    registry = scip.Registry()
    registry.add(scip.Provider("b", (), 5, scip.from_source))
    registry.add(scip.Provider("a", ("go",), 1, scip.from_source))
    assert registry.best_for("go").name == "a" and registry.best_for("python").name == "b"
    found, used = scip.from_source(spark.createDataFrame([("a.py", "python", "def f():\n    g()\ndef g():\n    pass\n")], "file_path string, language string, source_text string"))
    assert found.count() == 2 and used.where("role = 'reference'").count() == 1


def test_stream(spark, tmp_path):
    schema = "file_path string, language string, source_text string"
    rows = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1)
    rows(("a.py", "python", "def f():\n    g()\n"), ("b.py", "python", "def g():\n    pass\n")).write.parquet(str(tmp_path / "in"), mode="append")
    live = LiveGraph(spark, str(tmp_path / "live"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    live.follow(stream, str(tmp_path / "cp")).awaitTermination()
    assert {r["qualified_name"] for r in live.tables()[0].collect()} == {"a.py", "b.py", "f", "g"}
    rows(("a.py", "python", "def h():\n    g()\n")).write.parquet(str(tmp_path / "in"), mode="append")
    live.follow(stream, str(tmp_path / "cp")).awaitTermination()
    assert {r["qualified_name"] for r in live.tables()[0].collect()} == {"a.py", "b.py", "h", "g"}
    live.take(rows(("b.py", "python", None)), live.version)
    assert {r["qualified_name"] for r in live.tables()[0].where("kind <> 'File'").collect()} == {"f"}  # batch 1 again, from batch 0


def test_windows(spark):
    events = spark.createDataFrame([("2030-01-01 00:10:00", "a", 1.0), ("2030-01-01 00:50:00", "a", 2.0), ("2030-01-01 01:00:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r["events"], r["value"]) for r in windowed_counts(events).collect()) == [(1, 4.0), (2, 3.0)]
