"""Documents: validation, inventory, duplicates, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import content_sha256, word_count, words
from evalloom.runtime import broadcast_if_small


def with_suite(rows: DataFrame, suites: DataFrame, *columns: str) -> DataFrame:
    """`rows` with columns of their suite; suites are few, but that is checked before one is broadcast."""
    return rows.join(broadcast_if_small(suites).select("suite_id", *columns), "suite_id")


def first_of_each_source(documents: DataFrame) -> DataFrame:
    """One document a source id and suite: the one delivered first. Later ones with the same id are other versions."""
    first = documents.groupBy("suite_id", "source_id").agg(F.min("doc_pos").alias("doc_pos"))
    return documents.join(first, ["suite_id", "source_id", "doc_pos"], "left_semi")


def error_codes(evaluation_date: Column | str) -> Column:
    """Why a document is not valid, in fixed order. A missing hash or trust is an error; missing dates are none."""
    date = F.col(evaluation_date) if isinstance(evaluation_date, str) else evaluation_date
    state = F.coalesce("trust", F.lit("missing"))
    return F.array_compact(
        F.array(
            F.when(~content_sha256(F.col("content")).eqNullSafe(F.col("sha256")), F.lit("hash_mismatch")),
            F.when(state != "trusted", F.concat(F.lit("trust_"), state)),
            F.when(F.col("observed_at") > date, F.lit("observed_in_future")),
            F.when(F.col("expires_at") < date, F.lit("expired")),
        )
    )


def validate(documents: DataFrame, suites: DataFrame) -> DataFrame:
    """Documents with `errors` and `valid`, and the settings of their suite."""
    rows = with_suite(documents, suites, "evaluation_date", "chunk_size", "chunk_overlap")
    return rows.withColumn("errors", error_codes("evaluation_date")).withColumn("valid", F.size("errors") == 0)


def inventory(validated: DataFrame) -> DataFrame:
    """Documents, valid documents and the share of these, for each suite."""
    counts = validated.groupBy("suite_id").agg(F.count("*").alias("document_count"), F.count_if("valid").alias("valid_document_count"))
    return counts.withColumn("fresh_coverage", F.col("valid_document_count") / F.col("document_count"))


def duplicate_groups(documents: DataFrame) -> DataFrame:
    """Source ids of a suite that declare the same hash, sorted; invalid documents count as well."""
    ids = documents.where("sha256 is not null").select("suite_id", "sha256", "source_id").distinct()
    # Groups are counted first, so that only ids which do repeat are put into lists.
    repeated = ids.groupBy("suite_id", "sha256").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    listed = ids.join(repeated, ["suite_id", "sha256"]).groupBy("suite_id", "sha256")
    return listed.agg(F.sort_array(F.collect_list("source_id")).alias("source_ids"))


def chunk_count(n_words: Column, size: Column, overlap: Column) -> Column:
    """How many windows of `size` words, `overlap` of them shared, cover `n_words` words."""
    step = size - overlap
    return F.when(n_words == 0, 0).when(n_words <= size, 1).otherwise(1 + F.floor((n_words - size + step - 1) / step)).cast("int")


def chunk_counts(documents: DataFrame) -> DataFrame:
    rows = documents.select("suite_id", "source_id", word_count(F.col("content")).alias("n_words"), "chunk_size", "chunk_overlap")
    return rows.withColumn("n_chunks", chunk_count(F.col("n_words"), F.col("chunk_size"), F.col("chunk_overlap")))


def chunk(documents: DataFrame) -> DataFrame:
    """Overlapping word windows of each document: chunk_id, source_id, ordinal, text, document_sha256. Without a shuffle."""
    split = documents.select("suite_id", "source_id", "sha256", "chunk_size", "chunk_overlap", words(F.col("content")).alias("words"))
    counted = split.withColumn("n_words", F.size("words")).withColumn("n_chunks", chunk_count(F.col("n_words"), F.col("chunk_size"), F.col("chunk_overlap")))
    rows = counted.where("n_chunks > 0").withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    rows = rows.withColumn("start", F.col("ordinal") * (F.col("chunk_size") - F.col("chunk_overlap")))
    rows = rows.withColumn("end", F.least("n_words", F.col("start") + F.col("chunk_size")))
    chunk_id = F.format_string("%s:%d:%d-%d", "source_id", "ordinal", "start", "end")
    text = F.array_join(F.slice("words", F.col("start") + 1, F.col("end") - F.col("start")), " ")
    return rows.select("suite_id", chunk_id.alias("chunk_id"), "source_id", "ordinal", text.alias("text"), F.col("sha256").alias("document_sha256"))
