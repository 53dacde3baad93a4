"""Queries of the training-data operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import density, docpairs, knn, leaks, mixing, mojibake
from arbora.llm.syntax import files
from arbora.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = knn.search(table(spark, d, "vectors"), 10, least=0.9)
    return knn.similar_names(found, 10, 0.9).select("name_a", "name_b")


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    return knn.recall(knn.search(table(spark, d, "vectors"), 10), 10)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members = density.cluster(table(spark, d, "vectors")).members.where("cluster_id >= 0")
    pairs = table(spark, d, "cluster_pairs").select("name_a", "name_b").distinct()
    side = lambda s: members.select(F.col("name").alias(f"name_{s}"), F.col("cluster_id").alias(s))
    return pairs.join(side("a"), "name_a").join(side("b"), "name_b").where("a = b").select("name_a", "name_b")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return density.cluster(table(spark, d, "vectors")).clusters


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return files.checked(table(spark, d, "parse_results")).where(F.col("problem").isNotNull()).select("file_path")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return files.rates(table(spark, d, "parse_results"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = docpairs.pairs(table(spark, d, "parse_results"), table(spark, d, "nodes"), code=False)
    return found.where(F.col("reason").isNull()).select("qualified_name")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description of the pairs worth keeping."""
    found = docpairs.pairs(table(spark, d, "parse_results"), table(spark, d, "nodes"))
    return found.where(F.col("reason").isNull()).select("qualified_name", "language", "code", "docstring")


def p6_unpaired(spark: SparkSession, d: str) -> DataFrame:
    """Function and method nodes that no source file holds where they say."""
    return docpairs.unpaired(table(spark, d, "parse_results"), table(spark, d, "nodes"))


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    found = docpairs.pairs(table(spark, d, "parse_results"), table(spark, d, "nodes"), code=False)
    return found.groupBy("language", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("functions"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where("distance = 0").select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Items by the documents that hold a passage of theirs, changed in no more than one word."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.sum((F.col("distance") == 0).cast("int")).alias("unchanged"), F.max("run").alias("longest_run"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_recall, p3_found, p3_clusters, p5_found, p5_rates, p6_found, p6_pairs, p6_unpaired, p6_reasons, p8_found, p8_items, p9_mix, p9_shares, p10_found, p10_restored)}

SQL = {
    "p2_found": """
      WITH u AS (SELECT qualified_name AS name, any_value(vector)::DOUBLE[] AS v FROM vectors
                 WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: NOT isfinite(x) OR x IS NULL)) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1),
      r AS (SELECT a.name AS a, b.name AS b, list_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b ON a.name <> b.name),
      t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 6) DESC, b) AS n FROM r WHERE sim >= 0.9)
      SELECT DISTINCT least(a, b) AS name_a, greatest(a, b) AS name_b FROM t WHERE n <= 10""",
    "p8_found": r"""
      WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
      i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
      dg AS (SELECT id, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS s FROM d)),
      ig AS (SELECT id, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS s FROM i))
      SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig ON dg.g = ig.g""",
}
