"""From source files to the nodes and edges of the property graph."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.graph import test_subjects
from arbora.session import cut, spread
from arbora.sources import generic_facts, python_facts

FACTS = "file_path string, language string, fact string, pos int, kind string, name string, qualified string, parent string, source string, target string, line int, end_line int, is_test boolean, params array<string>, return_type string, docstring string, extra string"
_COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
#: Extractors by language; more are added with ``register``.
EXTRACTORS = {"python": lambda source, path, language: python_facts.facts(source, path)}


def register(language: str, extractor) -> None:
    """Sets the extractor of a language: (source, path, language) to a list of facts."""
    EXTRACTORS[language] = extractor


def extract(files: DataFrame) -> DataFrame:
    """Facts of (file_path, language, source_text), one row each; a failing file gives an ``error`` fact and nothing else."""
    extractors = dict(EXTRACTORS)

    def run(frames):
        for frame in frames:
            rows = []
            for path, language, text in frame[["file_path", "language", "source_text"]].itertuples(index=False):
                try:
                    found = extractors.get(language, generic_facts.facts)(text, path, language)
                except Exception as x:  # one bad file must not end the job
                    found = [{"fact": "error", "pos": 0, "name": f"{type(x).__name__}: {x}"}]
                for f in found:
                    f = {"file_path": path, "language": language, **f, "extra": json.dumps(f.get("extra") or {})}
                    rows.append([f.get(c) for c in _COLUMNS])
            out = pd.DataFrame(rows, columns=_COLUMNS)
            yield out.astype({c: "Int32" for c in ("pos", "line", "end_line")}).astype({"is_test": "boolean"})

    rows = files.where(F.col("source_text").isNotNull()).select("file_path", "language", "source_text")
    return rows.repartition(spread(files), "file_path").mapInPandas(run, FACTS)


def ingest(facts: DataFrame, methods: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the facts.

    Nodes of one qualified name: the last in order of path and position wins. Edges are a multiset; edge_id orders them by path and
    position. Besides what the extractors say there are File nodes, CONTAINS edges, TESTS edges by name, CONTROLS edges for calls
    under control flow (the receiver's name for method calls, or with ``methods`` the method's), and WRITES and READS of local variables.
    """
    # with the seed of a file's order instead of a global row number, ids need no single task
    node = facts.where(F.col("fact") == "node")
    own = node.select("file_path", "language", "pos", "kind", "name", F.coalesce(F.when(F.col("qualified") != "", F.col("qualified")), F.concat_ws(".", "parent", "name")).alias("qualified_name"), F.col("parent").alias("parent_qualified"), "line", "end_line", "is_test", "params", "return_type", "docstring", "extra")
    ok = facts.where(F.col("fact") != "error").select("file_path", "language").union(facts.where(F.col("fact") == "error").select("file_path", "language").limit(0)).distinct()
    file_nodes = ok.select("file_path", "language", F.lit(0).alias("pos"), F.lit("File").alias("kind"), F.element_at(F.split("file_path", "/"), -1).alias("name"), F.col("file_path").alias("qualified_name"), F.lit(None).cast("string").alias("parent_qualified"), F.lit(0).alias("line"), F.lit(0).alias("end_line"), F.lit(False).alias("is_test"), F.lit(None).cast("array<string>").alias("params"), F.lit(None).cast("string").alias("return_type"), F.lit(None).cast("string").alias("docstring"), F.lit("{}").alias("extra"))

    # local names: of repeated definitions in a file the last counts
    named = own.where(F.col("kind").isin("Function", "Method", "Test")).groupBy("file_path", F.col("name").alias("local")).agg(F.max_by("qualified_name", "pos").alias("full"))
    local = lambda df, column, out: df.join(named.withColumnRenamed("local", column).withColumnRenamed("full", f"_{out}"), ["file_path", column], "left").withColumn(out, F.coalesce(f"_{out}", column)).drop(f"_{out}")
    edge = lambda df, kind, source, target, confidence, pos="pos": df.select("file_path", F.col(pos).alias("pos"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), source.alias("source"), target.alias("target"), F.lit(confidence).alias("confidence"), F.lit("{}").alias("extra"))

    writes = local(facts.where(F.col("fact") == "write").select("file_path", "language", "pos", F.col("source").alias("f"), "name"), "f", "func")
    writes = writes.withColumn("var", F.concat_ws(".", "func", "name"))
    firsts = writes.groupBy("file_path", "var").agg(F.min("pos").alias("first"), F.min("language").alias("language"), F.min("name").alias("name"))
    reads = local(facts.where(F.col("fact") == "read").select("file_path", "pos", F.col("source").alias("f"), "name"), "f", "func").withColumn("var", F.concat_ws(".", "func", "name"))
    reads = reads.join(firsts.select("file_path", "var", "first"), ["file_path", "var"]).where(F.col("pos") >= F.col("first"))
    variables = firsts.select("file_path", "language", F.col("first").alias("pos"), F.lit("Variable").alias("kind"), "name", F.col("var").alias("qualified_name"), *[F.lit(None).cast(t).alias(c) for c, t in (("parent_qualified", "string"), ("line", "int"), ("end_line", "int"))], F.lit(False).alias("is_test"), F.lit(None).cast("array<string>").alias("params"), F.lit(None).cast("string").alias("return_type"), F.lit(None).cast("string").alias("docstring"), F.lit("{}").alias("extra"))
    taken = own.select("qualified_name").distinct()
    every = file_nodes.unionByName(own).unionByName(variables.join(taken, "qualified_name", "left_anti").select(*variables.columns))
    columns = [c for c in every.columns if c != "qualified_name"]
    nodes = every.groupBy("qualified_name").agg(F.max_by(F.struct(*columns), F.struct("file_path", "pos")).alias("v")).select("qualified_name", "v.*")
    nodes = nodes.select("qualified_name", "kind", "name", "file_path", "language", F.nullif("line", F.lit(0)).alias("range_start"), F.nullif("end_line", F.lit(0)).alias("range_end"), "parent_qualified", "is_test", "extra", "params", "return_type", "docstring")

    controls = facts.where(F.col("fact") == "control").withColumn("t", F.coalesce("name", "target") if methods else F.col("target")).select("file_path", "pos", F.col("source").alias("f"), "t")
    controls = local(local(controls, "f", "func"), "t", "callee").where(F.col("func") != F.col("callee"))
    inner = own.where(F.col("kind") != "Endpoint")
    handled = own.where((F.col("kind") == "Endpoint") & F.get_json_object("extra", "$.handler").isNotNull())
    tests = test_subjects(own.select("qualified_name", "kind", "name", "file_path")).withColumn("pos", F.lit(1 << 30))
    parts = [
        facts.where(F.col("fact") == "edge").select("file_path", "pos", "kind", "source", "target", F.lit(1.0).alias("confidence"), F.lit("{}").alias("extra")),
        edge(inner, "CONTAINS", F.coalesce("parent_qualified", "file_path"), F.col("qualified_name"), 1.0),
        edge(handled, "CONTAINS", F.get_json_object("extra", "$.handler"), F.col("qualified_name"), 1.0),
        edge(tests, "TESTS", F.col("source"), F.col("target"), 0.7),
        edge(controls, "CONTROLS", F.col("func"), F.col("callee"), 0.8),
        edge(writes, "WRITES", F.col("func"), F.col("var"), 0.9),
        edge(reads, "READS", F.col("func"), F.col("var"), 0.7),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    order = Window.partitionBy("file_path").orderBy("pos", "kind", "source", "target")
    numbered = rows.withColumn("n", F.row_number().over(order))
    # an edge's key is (edge_id, file_path): the id orders a file's edges, and its upper bits, a hash of the path, those of all files
    edge_id = F.shiftleft(F.xxhash64("file_path").bitwiseAND((1 << 42) - 1), 20) + F.col("n")
    return nodes, numbered.select(edge_id.alias("edge_id"), "kind", "source", "target", "file_path", "confidence", "extra")


def errors(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("fact") == "error").select("file_path", "language", F.col("name").alias("message"))


def register_languages(path: str) -> list[str]:
    """Adds the languages of a JSON file to those the scanner knows and gives their names.

    The file maps names to rules: types as pairs of pattern and kind, functions, imports, and bases, blocks, comment and strings where
    they differ from those of C.
    """
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    for name, rules in given.items():
        lists = {"types": tuple(map(tuple, rules.get("types", ()))), "functions": tuple(rules.get("functions", ())), "imports": tuple(rules.get("imports", ()))}
        generic_facts.LANGUAGES[name] = generic_facts.Rules(**(rules | lists))
    return list(given)


def build(files: DataFrame, methods: bool = False, control: bool = True, data: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of the files, facts extracted once; control and data flow can be left out."""
    facts = extract(files)
    left_out = [f for f, wanted in (("control", control), ("write", data), ("read", data)) if not wanted]
    facts = cut(facts.where(~F.col("fact").isin(left_out)) if left_out else facts)
    nodes, edges = ingest(facts, methods)
    return nodes, edges, errors(facts)
