"""Symbol indexes in SCIP's JSON form, and providers of definitions and occurrences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.sources.ingest import extract

SCHEMA = "metadata struct<project_root:string>, documents array<struct<relativePath:string, language:string, symbols:array<struct<symbol:string, displayName:string, kind:int>>, occurrences:array<struct<range:array<int>, symbol:string, symbolRoles:int>>>>, externalSymbols array<struct<symbol:string, displayName:string, kind:int>>"
# The index's symbol kinds as node kinds, and its role bits.
KINDS = {7: "Class", 8: "Constant", 9: "Method", 11: "Enum", 12: "Constant", 15: "Variable", 17: "Function", 21: "Interface", 26: "Method", 29: "Module", 30: "Namespace", 37: "Parameter", 49: "Struct", 54: "Type", 61: "Variable"}
DEFINITION, WRITE = 1, 8


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, occurrences) of index files: symbols of documents and external ones, occurrences with line from 1 and role."""
    index = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    document = index.select(F.explode("documents").alias("d")).select("d.*")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    named = lambda df, path: df.select(F.col("s.symbol").alias("qualified_name"), F.coalesce(F.try_element_at(kinds, F.col("s.kind")), F.lit("Variable")).alias("kind"), path.alias("file_path"), F.coalesce(F.nullif("s.displayName", F.lit("")), F.col("s.symbol")).alias("display_name"))
    inner = named(document.select("relativePath", F.explode("symbols").alias("s")), F.col("relativePath"))
    outer = named(index.select(F.explode("externalSymbols").alias("s")), F.lit(None).cast("string"))
    o = document.select("relativePath", F.explode("occurrences").alias("o"))
    role = F.when(F.col("o.symbolRoles").bitwiseAND(DEFINITION) > 0, "definition").when(F.col("o.symbolRoles").bitwiseAND(WRITE) > 0, "write").otherwise("reference")
    occurrences = o.select(F.col("o.symbol").alias("symbol"), F.col("relativePath").alias("file_path"), (F.col("o.range")[0] + 1).alias("line"), F.col("o.range")[1].alias("col"), role.alias("role"))
    return inner.unionByName(outer), occurrences


# Where an index may lie below a project's folder, the first that exists counts.
PLACES = ("index.json", "scip-index.json", ".scip/index.json")


def discover(spark: SparkSession, root: str) -> str | None:
    """The path of the index below root, on any file system that Spark reads; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    return next((f"{root}/{p}" for p in PLACES if fs.exists(path(f"{root}/{p}"))), None)


def occurrences_of(occurrences: DataFrame, role: str | None = None) -> DataFrame:
    """(symbol, file_path, places, first_line): in which files symbols occur, all roles or one, and how often."""
    rows = occurrences if role is None else occurrences.where(F.col("role") == role)
    return rows.groupBy("symbol", "file_path").agg(F.count("*").alias("places"), F.min("line").alias("first_line"))


def replace_files(stored: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """The occurrence store after the files were indexed again: their old occurrences go, the fresh ones come."""
    return stored.join(files.select("file_path").distinct(), "file_path", "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def occurrence_map(occurrences: DataFrame) -> DataFrame:
    """(file_path, line, col, symbol): one symbol a position, the greatest where several are given."""
    return occurrences.groupBy("file_path", "line", "col").agg(F.max("symbol").alias("symbol"))


@dataclass(frozen=True)
class Provider:
    """name, languages served (empty for all), priority (the lowest first), and files to (symbols, occurrences)."""

    name: str
    languages: tuple[str, ...]
    priority: int
    index: Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class Registry:
    def __init__(self):
        self._all: list[Provider] = []

    def add(self, provider: Provider) -> None:
        self._all = sorted([*self._all, provider], key=lambda p: (p.priority, p.name))

    def all_for(self, language: str) -> list[Provider]:
        return [p for p in self._all if not p.languages or language in p.languages]

    def best_for(self, language: str) -> Provider | None:
        return next(iter(self.all_for(language)), None)


def from_source(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and occurrences by name from the extractors' facts: definitions, and calls whose name one definition of the file has."""
    facts = extract(files)
    symbols = facts.where(F.col("fact") == "node").select(F.col("qualified").alias("qualified_name"), "kind", "file_path", F.col("name").alias("display_name"), "line")
    calls = facts.where((F.col("fact") == "edge") & (F.col("kind") == "CALLS")).select("file_path", F.col("target").alias("display_name"), "line")
    known = symbols.groupBy("file_path", "display_name").agg(F.min("qualified_name").alias("symbol"), F.count("*").alias("n")).where("n = 1")
    used = calls.join(known, ["file_path", "display_name"]).select("symbol", "file_path", "line", F.lit(0).alias("col"), F.lit("reference").alias("role"))
    defined = symbols.select(F.col("qualified_name").alias("symbol"), "file_path", "line", F.lit(0).alias("col"), F.lit("definition").alias("role"))
    return symbols.drop("line"), defined.unionByName(used)
