"""The inverted index of a suite's chunks: postings, term statistics, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import hashed_bucket, hashed_sign, tokens
from evalloom.runtime import broadcast_if_small


def tokenized(chunks: DataFrame) -> DataFrame:
    return chunks.select("suite_id", "chunk_id", tokens(F.col("text")).alias("tokens"))


def run_lengths(rows: DataFrame, array: str, *keep: str) -> DataFrame:
    """Each distinct token of an array with how often it occurs, by sorting within the row: no shuffle.

    Adds `token`, `tf` and `length` (of the whole array). Rows with an empty array give none.
    """
    # A generator keeps the sorted array from being computed again for each of its elements below.
    ordered = rows.select(*keep, F.explode(F.array(F.array_sort(array))).alias("sorted")).where(F.size("sorted") > 0)
    last = F.size("sorted") - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.element_at("sorted", i + 1) != F.element_at("sorted", F.greatest(i, F.lit(1)))))
    marked = ordered.withColumn("starts", starts).withColumn("length", F.size("sorted"))
    runs = marked.select(*keep, "sorted", "starts", "length", F.posexplode("starts").alias("nth", "start"))
    following = F.when(F.col("nth") + 1 < F.size("starts"), F.element_at("starts", F.least(F.col("nth") + 2, F.size("starts")))).otherwise(F.col("length"))
    return runs.select(*keep, F.element_at("sorted", F.col("start") + 1).alias("token"), (following - F.col("start")).alias("tf"), "length")


def postings_of(token_lists: DataFrame) -> DataFrame:
    """suite_id, chunk_id, token, tf and the chunk's length in tokens."""
    return run_lengths(token_lists, "tokens", "suite_id", "chunk_id")


def postings(chunks: DataFrame) -> DataFrame:
    return postings_of(tokenized(chunks))


def index_stats(chunks: DataFrame) -> DataFrame:
    return stats_of(tokenized(chunks))


def stats_of(token_lists: DataFrame) -> DataFrame:
    """Number of chunks and mean length in tokens of each suite, chunks without tokens included."""
    return token_lists.groupBy("suite_id").agg(F.count("*").alias("n_chunks"), F.avg(F.size("tokens")).alias("avg_length"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("suite_id", "token").agg(F.count("*").alias("df"))


def document_frequency_of(token_lists: DataFrame) -> DataFrame:
    """The same from token lists: a chunk's repeated tokens are dropped within the row."""
    return token_lists.select("suite_id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("suite_id", "token").agg(F.count("*").alias("df"))


def term_idf(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """df and both inverse document frequencies of each token of a suite."""
    n, df = F.col("n_chunks"), F.col("df")
    rows = frequencies.join(broadcast_if_small(stats).select("suite_id", "n_chunks"), "suite_id")
    return rows.select("suite_id", "token", "df", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("bm25_idf"), (F.log((n + 1) / (df + 1)) + 1).alias("tfidf_idf"))


def tfidf_norms(posted: DataFrame, terms: DataFrame) -> DataFrame:
    weight = F.col("tf") * F.col("tfidf_idf")
    return posted.join(terms, ["suite_id", "token"]).groupBy("suite_id", "chunk_id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))


def hashed_vectors(posted: DataFrame, terms: DataFrame, *key: str) -> DataFrame:
    """Sparse vectors of 128 slots: key, bucket, w. A token that the index doesn't know weighs 1."""
    weighed = posted.join(terms.select("suite_id", "token", "tfidf_idf"), ["suite_id", "token"], "left")
    weight = hashed_sign(F.col("token")) * F.col("tf") * F.coalesce("tfidf_idf", F.lit(1.0))
    return weighed.groupBy(*key, hashed_bucket(F.col("token")).alias("bucket")).agg(F.sum(weight).alias("w"))


def manifest_chunks(chunks: DataFrame) -> DataFrame:
    """What an index manifest says about each chunk: hashes and counts, no text."""
    return chunks.select("suite_id", "chunk_id", "source_id", "ordinal", "document_sha256", F.sha2("text", 256).alias("text_sha256"), F.size(tokens(F.col("text"))).alias("token_count"))
