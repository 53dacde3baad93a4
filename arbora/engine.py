"""The engine: build, save, open, refresh and query one indexed code base."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import vectors as V
from arbora.operators import clusters as C
from arbora.operators import embedding as E
from arbora.operators import export as X
from arbora.operators import graph as G
from arbora.operators import ranking as R
from arbora.operators import retrieval as Q
from arbora.operators.traversal import bfs
from arbora.plans.optimizer import TraversalPlan
from arbora.session import cut
from arbora.sources import ingest, walk
from arbora.sources.config import Config, from_mapping

#: Version of the saved form. Equal: opened; older: rebuilt by the caller; newer: refused.
FORMAT = 1
TABLES = ("nodes", "edges", "vectors", "members", "scores", "files")
#: Above this many and this share of changed files a refresh is a rebuild.
CHURN_FILES, CHURN_SHARE = 50, 0.30


class StateError(RuntimeError):
    """The saved state can't be used as it is."""


@dataclass
class Engine:
    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    members: DataFrame
    scores: DataFrame
    files: DataFrame
    config: Config = field(default_factory=Config)
    walks: dict = field(default_factory=dict, repr=False)

    # --- building ------------------------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, files: DataFrame, config: Config = Config(), progress: Callable[[str], None] | None = None) -> Engine:
        """From (file_path, language, source_text, mtime_ns, size), as ``walk.read_folder`` gives them.

        progress is told the stage that begins: parse, prune, derive.
        """
        tell = progress or (lambda stage: None)
        tell("parse")
        nodes, edges, _ = ingest.build(files, control=config.enable_cfg, data=config.enable_dfg)
        if config.prune_graph:
            tell("prune")
            nodes, edges = G.prune(nodes, edges)
        tell("derive")
        return cls._derive(files.sparkSession, cut(nodes), cut(edges), None, files.select("file_path", "mtime_ns", "size"), config)

    @classmethod
    def _derive(cls, spark, nodes, edges, vectors, files, config) -> Engine:
        if vectors is None:
            vectors = E.embed(E.texts(nodes), E.provider(config.embedding_provider, dims=config.embedding_dimensions))
        vectors = cut(vectors)
        members = C.communities(edges.where("source <> '' and target <> ''")) if config.use_louvain else C.kmeans(vectors, config.embedding_dimensions, config.min_cluster_size)
        scores = R.centrality(nodes, edges, semantic_only=config.centrality_ranking)
        return cls(spark, nodes, edges, vectors, cut(members), cut(scores), files, config)

    # --- state ---------------------------------------------------------------------------------------------------------------

    def save(self, folder: str) -> None:
        """Every table as Parquet in a new version folder; a numbered manifest that names it is put in place last, by rename."""
        fs, path = _file_system(self.spark, folder)
        version = f"v{self.spark.sparkContext.startTime}-{id(self):x}"
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
        before = _manifests(fs, path, folder)
        number = int(before[-1].split("-")[1]) + 1 if before else 1
        out = fs.create(path(f"{folder}/manifest.tmp"), True)
        out.write(bytearray(json.dumps({"format": FORMAT, "version": version, "config": asdict(self.config)}).encode()))
        out.close()
        if not fs.rename(path(f"{folder}/manifest.tmp"), path(f"{folder}/manifest-{number:09d}")):
            raise StateError("the manifest couldn't be put in place")
        for name in before:  # only now; until here the older state is the one that opens
            fs.delete(path(f"{folder}/{name}"), False)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Engine:
        fs, path = _file_system(spark, folder)
        names = _manifests(fs, path, folder)
        if not names:
            raise StateError("nothing is saved here")
        manifest = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/{names[-1]}").collect()))
        if manifest["format"] != FORMAT:
            raise StateError("saved in a newer form" if manifest["format"] > FORMAT else "saved in an older form: build it anew")
        tables = {name: spark.read.parquet(f"{folder}/{manifest['version']}/{name}") for name in TABLES}
        return cls(spark, config=from_mapping(manifest["config"]), **tables)

    def refresh(self, files: DataFrame) -> tuple[Engine, DataFrame]:
        """(engine, stale) after the files now present: changed and new ones parsed again, removed ones dropped, derived tables renewed.

        Edges of other files into a changed one stay. With much churn everything is built anew; without any the engine is this one.
        """
        now = files.select("file_path", "mtime_ns", "size")
        stale = cut(G.stale_files(self.files, now))
        count = stale.count()
        if not count:
            return self, stale
        if count > CHURN_FILES and count > CHURN_SHARE * max(1, self.files.count()):
            return Engine.build(files, self.config), stale
        nodes, edges = G.delete_files_narrow(self.nodes, self.edges, stale)
        again = files.join(stale.where("state <> 'removed'").select("file_path"), "file_path", "left_semi")
        fresh_nodes, fresh_edges, _ = ingest.build(again, control=self.config.enable_cfg, data=self.config.enable_dfg)
        nodes, edges = cut(G.upsert(nodes, fresh_nodes)), cut(G.append(edges, fresh_edges))
        how = E.provider(self.config.embedding_provider, dims=self.config.embedding_dimensions)
        return Engine._derive(self.spark, nodes, edges, E.refresh(self.vectors, nodes, stale, how), now, self.config), stale

    # --- queries -------------------------------------------------------------------------------------------------------------

    def hits(self, text: str) -> DataFrame:
        """(qualified_name, cosine) of all vectors to the text's, as the provider embeds it."""
        how = E.provider(self.config.embedding_provider, dims=self.config.embedding_dimensions)
        vector = [float(x) for x in next(iter(how(iter([[text]]))))[0]]
        asked = F.array(*[F.lit(x) for x in vector])
        return self.vectors.select("qualified_name", F.round(V.cosine(F.col("vector"), asked), 9).alias("cosine"))

    def retrieve(self, text: str, seeds: list[str] | None = None, intent: str | None = None) -> DataFrame:
        given = None if seeds is None else self.spark.createDataFrame([(s,) for s in seeds], "qualified_name string")
        found = self.hits(text).where(F.col("cosine") >= self.config.min_semantic)
        return Q.retrieve(found, self.nodes, self.edges, self.scores, C.memberships(None, self.members), given, self.config.top_k, self.config.max_tokens, self.config.bfs_depth, intent)

    def context(self, text: str, seeds: list[str] | None = None, intent: str | None = None, max_tokens: int = 3000) -> DataFrame:
        return Q.context(self.retrieve(text, seeds, intent), self.nodes, text, max_tokens)

    def reindex(self, file: DataFrame) -> Engine:
        """The engine after the given files, and no others, were parsed again; all files stay listed."""
        kept = self.files.join(file.select("file_path"), "file_path", "left_anti")
        now = kept.unionByName(file.select("file_path", "mtime_ns", "size"))
        nodes, edges = G.delete_files_narrow(self.nodes, self.edges, file)
        fresh_nodes, fresh_edges, _ = ingest.build(file, control=self.config.enable_cfg, data=self.config.enable_dfg)
        nodes, edges = cut(G.upsert(nodes, fresh_nodes)), cut(G.append(edges, fresh_edges))
        how = E.provider(self.config.embedding_provider, dims=self.config.embedding_dimensions)
        stale = file.select("file_path", F.lit("changed").alias("state"))
        return Engine._derive(self.spark, nodes, edges, E.refresh(self.vectors, nodes, stale, how), now, self.config)

    def expand(self, results: DataFrame, files: DataFrame) -> Engine:
        """The engine with control and data flow of the results' files only, for one that was built without; files as for ``build``.

        Only these files are parsed; vectors, clusters and scores stay.
        """
        chosen = files.join(results.select("file_path").where("file_path IS NOT NULL").distinct(), "file_path", "left_semi")
        nodes, edges, _ = ingest.build(chosen)
        flow = edges.where(F.col("kind").isin("CONTROLS", "WRITES", "READS"))
        old = self.edges.join(chosen.select("file_path"), "file_path", "left_anti").select(*self.edges.columns)
        kept = self.edges.where(~F.col("kind").isin("CONTROLS", "WRITES", "READS")).join(chosen.select("file_path"), "file_path", "left_semi").select(*self.edges.columns)
        return replace(self, nodes=cut(G.upsert(self.nodes, nodes.where("kind = 'Variable'"))), edges=cut(G.append(old.unionByName(kept), flow)), walks={})

    def walk(self, starts: list[str], plan: TraversalPlan = TraversalPlan()) -> DataFrame:
        """The breadth-first walk from the starts, kept for the next time the same is asked of this engine."""
        key = tuple(sorted(set(starts))), plan
        if key not in self.walks:
            self.walks[key] = bfs(self.nodes, self.edges, self.spark.createDataFrame([(s,) for s in key[0]], "qualified_name string"), plan).persist()
        return self.walks[key]

    def impact(self, name: str, max_depth: int = 4) -> DataFrame:
        return Q.impact(self.nodes, self.edges, self.spark.createDataFrame([(name,)], "qualified_name string"), max_depth)

    def explain(self, symbol: str, limit: int = 20) -> DataFrame:
        return Q.explain(self.nodes, self.edges, symbol, limit)

    def top_nodes(self, n: int = 20, order: str = "composite") -> DataFrame:
        return R.top(self.scores, n, order)

    def export(self, folder: str) -> None:
        labels = C.labels(self.members)
        X.write_document(X.nodes_view(self.nodes, self.scores, self.members, labels), X.edges_view(self.edges), X.clusters_view(self.members, labels), folder)

    def snapshot(self, folder: str) -> None:
        """Nodes, edges and files as JSON lines, without loss, with the version in a file of its own."""
        for name in ("nodes", "edges", "files"):
            getattr(self, name).write.mode("overwrite").json(f"{folder}/{name}")
        self.spark.createDataFrame([(FORMAT,)], "version int").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def load_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, files) of a snapshot; another version is refused."""
    from arbora.schema import EDGES, NODES

    version = spark.read.schema("version int").json(f"{folder}/manifest").first()
    if version is None or version[0] != FORMAT:
        raise StateError("the snapshot has another version")
    return spark.read.schema(NODES).json(f"{folder}/nodes"), spark.read.schema(EDGES).json(f"{folder}/edges"), spark.read.schema("file_path string, mtime_ns long, size long").json(f"{folder}/files")


def _manifests(fs, path, folder: str) -> list[str]:
    """The manifests in the folder, the one that counts last."""
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path(folder))) if n.startswith("manifest-"))


def _file_system(spark: SparkSession, folder: str):
    make = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = make(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(make(folder))
    return fs, make


def main(argv: list[str] | None = None) -> None:
    """index, query, impact, explain and export from the command line."""
    import argparse

    from arbora.session import local_session

    parser = argparse.ArgumentParser(prog="arbora")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, extra in (("index", ["root"]), ("query", ["text"]), ("impact", ["name"]), ("explain", ["name"]), ("export", ["out"])):
        sub = verbs.add_parser(verb)
        sub.add_argument("state")
        for name in extra:
            sub.add_argument(name)
    args = parser.parse_args(argv)
    spark = local_session()
    if args.verb == "index":
        Engine.build(walk.read_folder(spark, args.root)).save(args.state)
        return
    engine = Engine.open(spark, args.state)
    if args.verb == "query":
        print(engine.context(args.text).first()[0])
    elif args.verb == "export":
        engine.export(args.out)
    else:
        (engine.impact(args.name) if args.verb == "impact" else engine.explain(args.name)).show(100, truncate=False)


if __name__ == "__main__":
    main()
