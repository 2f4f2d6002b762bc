"""Judging each question: retrieval measures, citations, claim support, verdict.

A question's retrieved sources, expected sources and citations are short lists (k and the contract bound them), so the
measures are array expressions on one row a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import tokens
from evalloom.operators.corpus import with_suite

KEY = ["suite_id", "question_id"]
MIN_COVERAGE = 0.75


def _empty() -> Column:
    return F.array().cast("array<string>")


def asked_questions(questions: DataFrame) -> DataFrame:
    """Questions with null lists as empty ones, null flags as false, `citations` as the distinct ids of all claims, and `abstained`. Rows repeated in full count once."""
    rows = questions.select(
        "suite_id", "question_id", "question_pos", "text", F.coalesce("expected_source_ids", _empty()).alias("expected"), F.coalesce("no_answer", F.lit(False)).alias("no_answer"), F.coalesce("adversarial", F.lit(False)).alias("adversarial"), F.col("response.answer").alias("answer"), F.coalesce("response.claims", F.array().cast("array<struct<text:string,citations:array<string>>>")).alias("claims")
    ).distinct()
    cited = F.array_distinct(F.flatten(F.transform("claims", lambda c: F.coalesce(c["citations"], _empty()))))
    return rows.withColumn("expected", F.array_distinct("expected")).withColumn("citations", cited).withColumn("abstained", F.col("answer").isNull())


def with_retrieved(asked: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Adds `sources`, the source ids of the retrieved chunks by rank; questions without a hit keep an empty list."""
    ranked = retrieved.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "source_id"))).alias("r"))
    sources = ranked.select(*KEY, F.transform("r", lambda x: x["source_id"]).alias("sources"))
    return asked.join(sources, KEY, "left").withColumn("sources", F.coalesce("sources", _empty()))


def with_valid_sources(asked: DataFrame, valid_documents: DataFrame) -> DataFrame:
    """Adds `valid`, those of a question's expected and cited sources that are valid documents of its suite."""
    named = asked.select(*KEY, F.explode(F.array_union("expected", "citations")).alias("source_id"))
    known = named.join(valid_documents.select("suite_id", "source_id").distinct(), ["suite_id", "source_id"], "left_semi")
    valid = known.groupBy(*KEY).agg(F.collect_set("source_id").alias("valid"))
    return asked.join(valid, KEY, "left").withColumn("valid", F.coalesce("valid", _empty()))


def recall_at_k() -> Column:
    return F.when(F.size("expected") == 0, 1.0).otherwise(F.size(F.array_intersect("expected", "sources")) / F.size("expected"))


def reciprocal_rank() -> Column:
    first = F.array_position(F.transform("sources", lambda s: F.array_contains("expected", s)), True)
    return F.when(F.size("expected") == 0, 1.0).when(first > 0, 1 / first).otherwise(0.0)


def precision_at_k() -> Column:
    """Expected sources found, each once, as a share of what was retrieved."""
    nothing = F.when(F.size("expected") == 0, 1.0).otherwise(0.0)
    return F.when(F.size("sources") == 0, nothing).otherwise(F.size(F.array_intersect("sources", "expected")) / F.size("sources"))


def ndcg_at_k(k: Column) -> Column:
    """Binary gain at the first place of each expected source, against the best possible order."""
    gain = F.aggregate(F.array_intersect("sources", "expected"), F.lit(0.0), lambda acc, s: acc + 1 / F.log2(F.array_position("sources", s) + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("expected"), k))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    return F.when(F.size("expected") == 0, 1.0).otherwise(gain / ideal)


def citation_scores() -> tuple[Column, Column]:
    """Precision and recall of citations against the expected sources that were valid and retrieved."""
    eligible = F.array_intersect(F.array_intersect("expected", "valid"), "sources")
    right = F.size(F.array_intersect("citations", eligible))
    precision = F.when(F.size("citations") > 0, right / F.size("citations")).when(F.size("expected") == 0, 1.0).otherwise(0.0)
    return precision, F.when(F.size("expected") == 0, 1.0).otherwise(right / F.size("expected"))


def claim_support(asked: DataFrame, valid_documents: DataFrame) -> DataFrame:
    """Each claim with `token_coverage`, `supported` and `reasons`.

    A claim's tokens are sought in the whole texts of the documents it cites. Both sides are joined token by token, so
    that no document's tokens are copied to each claim.
    """
    claims = asked.select(*KEY, F.posexplode("claims").alias("claim_pos", "claim"))
    claims = claims.select(*KEY, "claim_pos", F.coalesce("claim.citations", _empty()).alias("citations"), F.array_distinct(tokens(F.col("claim.text"))).alias("tokens"))
    cited = claims.select(*KEY, "claim_pos", "tokens", F.posexplode("citations").alias("nth", "source_id"))
    known = valid_documents.select("suite_id", "source_id").distinct().withColumn("known", F.lit(True))
    missing = cited.drop("tokens").join(known, ["suite_id", "source_id"], "left").where("known is null").groupBy(*KEY, "claim_pos").agg(F.array_sort(F.collect_list(F.struct("nth", "source_id"))).alias("m"))
    missing = missing.select(*KEY, "claim_pos", F.transform("m", lambda x: F.concat(F.lit("missing_source:"), x["source_id"])).alias("missing"))

    wanted = cited.select(*KEY, "claim_pos", "source_id", F.explode("tokens").alias("token"))
    sources = valid_documents.join(cited.select("suite_id", "source_id").distinct(), ["suite_id", "source_id"], "left_semi")
    there = sources.select("suite_id", "source_id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("token"))
    found = wanted.join(there, ["suite_id", "source_id", "token"], "left_semi").select(*KEY, "claim_pos", "token").distinct().groupBy(*KEY, "claim_pos").agg(F.count("*").alias("found"))

    rows = claims.join(missing, [*KEY, "claim_pos"], "left").join(found, [*KEY, "claim_pos"], "left")
    none = F.size("tokens") == 0
    coverage = F.when(none | F.col("missing").isNotNull(), 0.0).otherwise(F.coalesce("found", F.lit(0)) / F.greatest(F.size("tokens"), F.lit(1)))
    rows = rows.withColumn("coverage", coverage)
    reasons = F.when(none, F.array(F.lit("empty_claim"))).when(F.col("missing").isNotNull(), F.col("missing")).when(F.col("coverage") < MIN_COVERAGE, F.array(F.lit("claim_not_supported"))).otherwise(_empty())
    return rows.select(*KEY, "claim_pos", "citations", F.col("coverage").alias("token_coverage"), (F.size(reasons) == 0).alias("supported"), reasons.alias("reasons"))


def judge(questions: DataFrame, retrieved: DataFrame, valid_documents: DataFrame, suites: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """One record a question with every measure, unrounded, its verdict and the codes of what failed."""
    asked = asked_questions(questions)
    support = claim_support(asked, valid_documents) if support is None else support
    claims = support.groupBy(*KEY).agg(F.count("*").alias("n_claims"), F.count_if("supported").alias("n_supported"))
    rows = with_suite(with_valid_sources(with_retrieved(asked, retrieved), valid_documents), suites, "retrieval_k")
    rows = rows.join(claims, KEY, "left").fillna(0, ["n_claims", "n_supported"])
    citation_precision, citation_recall = citation_scores()
    errors = F.sort_array(F.array_except("citations", "sources"))
    rows = rows.select(
        *KEY, "question_pos", "adversarial", "no_answer", "abstained", "n_claims", "n_supported", "sources",
        recall_at_k().alias("recall_at_k"), precision_at_k().alias("precision_at_k"), reciprocal_rank().alias("reciprocal_rank"), ndcg_at_k(F.col("retrieval_k")).alias("ndcg_at_k"),
        citation_precision.alias("citation_precision"), citation_recall.alias("citation_recall"), errors.alias("citation_errors"),
        ((F.size(errors) == 0) & (F.size(F.array_except("citations", "valid")) == 0)).alias("citations_valid"),
        (F.col("abstained") == F.col("no_answer")).alias("no_answer_correct"),
        F.when(F.col("n_claims") > 0, F.col("n_supported") == F.col("n_claims")).otherwise(F.col("no_answer") & F.col("abstained")).alias("grounded"),
    )
    failures = F.array_compact(
        F.array(
            F.when(F.col("recall_at_k") < 1, F.lit("retrieval_miss")),
            F.when(~F.col("citations_valid"), F.lit("invalid_citation")),
            F.when(~F.col("no_answer_correct"), F.lit("no_answer_mismatch")),
            F.when(~F.col("grounded"), F.lit("ungrounded_claim")),
        )
    )
    return rows.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)
