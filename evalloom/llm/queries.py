"""The queries of this subpackage: each takes (spark, directory of the tables) and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.canonical import CanonicalGroups, group_by_canonical_content
from evalloom.llm.consensus import consensus_values
from evalloom.llm.leakage import find_leaks
from evalloom.llm.neardup import NearDuplicates, find_near_duplicates
from evalloom.llm.packing import pack_texts
from evalloom.llm.pairs import find_defective_pairs, one_defect
from evalloom.llm.splitting import split_oversized
from evalloom.llm.survivor import surviving_fields
from evalloom.llm.topn import latest_scores, top_n
from evalloom.llm.truncation import find_truncated, truncation_by_source
from evalloom.runtime import broadcast_if_small, read_table


def _canonical(spark: SparkSession, directory: str, *keep: str) -> CanonicalGroups:
    return group_by_canonical_content(read_table(spark, directory, "source_docs"), "record_id", "content", keep)


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    members = _canonical(spark, directory).members
    return members.where("record_id <> first_id").select(F.col("first_id").alias("first_record_id"), F.col("record_id").alias("copy_record_id"))


def p1_contents(spark: SparkSession, directory: str) -> DataFrame:
    return _canonical(spark, directory).collapsed().withColumnRenamed("first_id", "first_record_id")


def _near_duplicates(spark: SparkSession, directory: str) -> NearDuplicates:
    records = read_table(spark, directory, "source_docs").select(F.lit("record").alias("kind"), F.col("record_id").cast("string").alias("key"), F.col("content").alias("text"), F.lit(True).alias("fields"))
    chunks = read_table(spark, directory, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "text", F.lit(False).alias("fields"))
    return find_near_duplicates(records.unionByName(chunks))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return _near_duplicates(spark, directory).pairs().withColumnRenamed("kind", "item_kind")


def p2_groups(spark: SparkSession, directory: str) -> DataFrame:
    return _near_duplicates(spark, directory).groups().withColumnsRenamed({"kind": "item_kind", "key": "item_key"})


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return one_defect(find_defective_pairs(read_table(spark, directory, "questions")))


def p3_parts(spark: SparkSession, directory: str) -> DataFrame:
    return find_defective_pairs(read_table(spark, directory, "questions"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    scored = latest_scores(read_table(spark, directory, "ranked"), "question_id", "chunk_id", "score", "logged_at")
    return top_n(scored, 5).select(F.col("g").alias("question_id"), F.col("i").alias("chunk_id"))


def p4_ranked(spark: SparkSession, directory: str) -> DataFrame:
    scored = latest_scores(read_table(spark, directory, "ranked"), "question_id", "chunk_id", "score", "logged_at")
    return top_n(scored, 5).select(F.col("g").alias("question_id"), F.col("place"), F.col("i").alias("chunk_id"), F.col("s").alias("score"))


def _survivors(spark: SparkSession, directory: str) -> DataFrame:
    members = _canonical(spark, directory, "suite_id", "trust", "observed_at", "expires_at", "license").members
    dates = broadcast_if_small(read_table(spark, directory, "suites").select("suite_id", "evaluation_date").dropDuplicates(["suite_id"]))
    return surviving_fields(members.join(dates, "suite_id", "left"), "first_id", "record_id").withColumnRenamed("first_id", "first_record_id")


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return _survivors(spark, directory).select("first_record_id", "field_name", "from_record_id")


def p5_records(spark: SparkSession, directory: str) -> DataFrame:
    return _survivors(spark, directory)


def p5_consensus(spark: SparkSession, directory: str) -> DataFrame:
    """Fields without a rule of their own: the title and address most of a set's records agree on, by their trust."""
    members = _canonical(spark, directory, "trust", "title", "source_url").members
    weight = F.when(F.lower(F.trim("trust")) == "trusted", 3).when(F.lower(F.trim("trust")) == "untrusted", 2).otherwise(1)
    return consensus_values(members.withColumn("weight", weight), "first_id", "record_id", "weight", ("title", "source_url")).withColumnRenamed("first_id", "first_record_id")


def _pieces(spark: SparkSession, directory: str) -> DataFrame:
    suites = broadcast_if_small(read_table(spark, directory, "suites").select("suite_id", F.col("chunk_size").alias("size"), F.col("chunk_overlap").alias("overlap")).dropDuplicates(["suite_id"]))
    records = read_table(spark, directory, "source_docs").select(F.lit("record").alias("kind"), F.col("record_id").cast("string").alias("key"), F.col("content").alias("text"), "suite_id")
    chunks = read_table(spark, directory, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "text", "suite_id")
    return split_oversized(records.unionByName(chunks).join(suites, "suite_id"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    # An item has a second piece exactly if it was too large.
    return _pieces(spark, directory).where("ordinal = 1").select(F.col("kind").alias("item_kind"), F.col("key").alias("item_key")).distinct()


def p6_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return _pieces(spark, directory).select(F.col("kind").alias("item_kind"), F.col("key").alias("item_key"), "ordinal", "text", "n_words")


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    # A document that fits no single container has its pieces in several.
    packed = pack_texts(read_table(spark, directory, "documents"), "doc_id", "text")
    return packed.groupBy("doc_id").agg(F.min("container").alias("low"), F.max("container").alias("high")).where("low <> high").select("doc_id")


def p7_containers(spark: SparkSession, directory: str) -> DataFrame:
    return pack_texts(read_table(spark, directory, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, directory: str) -> DataFrame:
    return find_leaks(read_table(spark, directory, "documents"), "doc_id", "text", read_table(spark, directory, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return _leaks(spark, directory).where("longest_run >= 12").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, directory: str) -> DataFrame:
    return _leaks(spark, directory)


def _truncated(spark: SparkSession, directory: str) -> DataFrame:
    return find_truncated(read_table(spark, directory, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return _truncated(spark, directory).where("cut").select("doc_id").distinct()


def p9_sources(spark: SparkSession, directory: str) -> DataFrame:
    return truncation_by_source(_truncated(spark, directory), "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_contents, p2_found, p2_groups, p3_found, p3_parts, p4_found, p4_ranked, p5_found, p5_records, p5_consensus, p6_found, p6_pieces, p7_found, p7_containers, p8_found, p8_leaks, p9_found, p9_sources)}
