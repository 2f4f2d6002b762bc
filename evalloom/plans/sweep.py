"""Configuration sweeps: one plan evaluates every configuration of every suite.

A run is a suite under a configuration; runs go through the pipeline as suites of their own. What depends on the
chunking alone is built once a chunking and shared by the strategies, and documents are validated once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.operators import corpus, judging, metrics, scoring
from evalloom.runtime import broadcast_if_small, cut_lineage

MAX_RUNS = 32


class SweepError(ValueError):
    """A sweep's dimensions are out of bounds."""


def _dimension(name: str, values: list) -> list:
    if not isinstance(values, (list, tuple)) or not 1 <= len(values) <= MAX_RUNS or len(set(values)) != len(values):
        raise SweepError(f"{name} must be 1 to {MAX_RUNS} different values")
    return list(values)


def configurations(strategies: list[str], chunk_sizes: list[int], overlaps: list[int]) -> list[tuple[str, int, int]]:
    """All combinations whose overlap is smaller than the chunk; 1 to 32 of them."""
    runs = [(s, c, o) for s in _dimension("strategies", strategies) for c in _dimension("chunk sizes", chunk_sizes) for o in _dimension("overlaps", overlaps) if o < c]
    if not 1 <= len(runs) <= MAX_RUNS:
        raise SweepError(f"a sweep has 1 to {MAX_RUNS} runs")
    return runs


def grid(spark: SparkSession, strategies: list[str], chunk_sizes: list[int], overlaps: list[int]) -> DataFrame:
    return spark.createDataFrame(configurations(strategies, chunk_sizes, overlaps), "strategy string, chunk_size int, chunk_overlap int")


def run(documents: DataFrame, questions: DataFrame, suites: DataFrame, configs: DataFrame) -> DataFrame:
    """Metrics, quality score and place of every configuration (`strategy`, `chunk_size`, `chunk_overlap`) for every suite."""
    chunkings = configs.select("chunk_size", "chunk_overlap").distinct()
    run_id = F.concat_ws("\x1f", "suite_id", "chunk_size", "chunk_overlap")
    validated = corpus.validate(documents, suites)
    inventory = corpus.inventory(validated)
    valid = cut_lineage(validated.where("valid").select("suite_id", "source_id", "content", "sha256"))
    # A chunking of a suite stands as a suite: a bounded number of copies, as there are at most MAX_RUNS of them.
    runs = suites.drop("chunk_size", "chunk_overlap").join(broadcast_if_small(chunkings)).withColumns({"own": F.col("suite_id"), "suite_id": run_id})
    runs = cut_lineage(runs)
    copies = broadcast_if_small(runs.select(F.col("own").alias("suite_id"), F.col("suite_id").alias("run"), "chunk_size", "chunk_overlap"))
    as_run = lambda rows: rows.join(copies, "suite_id").withColumn("suite_id", F.col("run")).drop("run")
    sources = as_run(valid)
    index = scoring.Index(corpus.chunk(sources), as_run(questions).drop("chunk_size", "chunk_overlap"))
    asked = cut_lineage(judging.asked_questions(questions))
    support = as_run(judging.claim_support(asked, valid)).drop("chunk_size", "chunk_overlap")
    support = cut_lineage(support)

    parts = []
    for strategy in [r.strategy for r in configs.select("strategy").distinct().collect()]:
        hits = scoring.retrieve(strategy, index, runs).withColumn("source_id", F.regexp_extract("chunk_id", "^(.*):\\d+:\\d+-\\d+$", 1))
        records = judging.judge(as_run(questions).drop("chunk_size", "chunk_overlap"), hits, sources, runs, support)
        parts.append(records.withColumn("strategy", F.lit(strategy)))
    records = reduce(DataFrame.unionByName, parts)
    keyed = records.withColumn("suite_id", F.concat_ws("\x1e", "suite_id", "strategy"))
    measured = metrics.suite_metrics(keyed, inventory.limit(0))
    names = F.split("suite_id", "[\x1e\x1f]")
    rows = measured.drop("fresh_coverage").select(names[0].alias("suite_id"), names[1].cast("int").alias("chunk_size"), names[2].cast("int").alias("chunk_overlap"), names[3].alias("strategy"), *[c for c in measured.columns if c not in ("suite_id", "fresh_coverage")])
    rows = rows.join(configs, ["strategy", "chunk_size", "chunk_overlap"], "left_semi").join(inventory.select("suite_id", "fresh_coverage"), "suite_id")
    rows = rows.withColumn("quality_score", F.bround(F.round(metrics.quality_score(), 12), 6))
    best = Window.partitionBy("suite_id").orderBy(F.desc("quality_score"), F.desc(F.round("pass_rate", 9)), F.desc(F.round("recall_at_k", 9)), "strategy", "chunk_size", "chunk_overlap")
    return rows.withColumn("place", F.row_number().over(best))
