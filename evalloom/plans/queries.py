"""The engine's queries over the test tables: each takes (spark, directory of the tables) and gives a DataFrame.

Documents are the first record of each source id of a suite; questions, suites and responses are taken as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.text import content_sha256, hashed_bucket, hashed_sign, is_blank, tokens
from evalloom.operators import corpus, index, judging, metrics, scoring
from evalloom.plans import sweep
from evalloom.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The inputs of one directory and what is derived from them, each built when asked for."""

    def __init__(self, spark: SparkSession, directory: str):
        self.suites = read_table(spark, directory, "suites")
        self.questions = read_table(spark, directory, "questions")
        self.documents = corpus.first_of_each_source(read_table(spark, directory, "source_docs"))

    @cached_property
    def validated(self) -> DataFrame:
        return corpus.validate(self.documents, self.suites)

    @cached_property
    def valid(self) -> DataFrame:
        return self.validated.where("valid")

    @cached_property
    def chunks(self) -> DataFrame:
        return corpus.chunk(self.valid)

    @cached_property
    def asked(self) -> DataFrame:
        return judging.asked_questions(self.questions)

    def index(self) -> scoring.Index:
        return scoring.Index(self.chunks, self.asked)

    def retrieved(self, strategy: str) -> DataFrame:
        return with_source(scoring.retrieve(strategy, self.index(), self.suites))

    def retrieved_by_own(self) -> DataFrame:
        """What each suite's own strategy finds; a suite that names none is ranked by overlap."""
        built, own, parts = self.index(), F.coalesce("retrieval_strategy", F.lit("overlap")), []
        for strategy in sorted(r[0] for r in self.suites.select(own).distinct().collect()) or ["overlap"]:
            suites = self.suites.where(own == strategy)
            parts.append(scoring.retrieve(strategy, built, suites))
        return with_source(reduce(DataFrame.unionByName, parts))

    def records(self, strategy: str = "bm25", own: bool = False) -> DataFrame:
        return judging.judge(self.questions, self.retrieved_by_own() if own else self.retrieved(strategy), self.valid, self.suites)


def with_source(retrieved: DataFrame) -> DataFrame:
    """The source id is what stands before the last two parts of a chunk id."""
    return retrieved.withColumn("source_id", F.regexp_extract("chunk_id", "^(.*):\\d+:\\d+-\\d+$", 1))


def joined(column: str | Column) -> Column:
    return F.array_join(column, ",")


def r6(name: str) -> Column:
    # Sums depend on their order in the last digits: these go first, so that halves are rounded alike. Adding zero turns a negative zero into zero.
    return (F.bround(F.round(name, 12), 6) + F.lit(0.0)).alias(name)


def contract_violations(spark: SparkSession, directory: str) -> DataFrame:
    """Records that break the contract of a document, and how."""
    t = read_table(spark, directory, "source_docs")
    blank = lambda c: is_blank(F.col(c))
    codes = {
        "source_id": ~F.coalesce(F.col("source_id").rlike("^[a-z0-9][a-z0-9._-]{0,63}\\z"), F.lit(False)),
        "title": blank("title") | (F.length("title") > 200),
        "source_url": blank("source_url") | (F.length("source_url") > 500),
        "license": blank("license") | (F.length("license") > 100),
        "trust": ~F.coalesce(F.col("trust").isin("trusted", "untrusted", "blocked"), F.lit(False)),
        "observed_at": F.col("observed_at").isNull(),
        "content": blank("content") | (F.length("content") > 200_000),
        "sha256": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}\\z"), F.lit(False)),
    }
    found = F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in codes.items())))
    return t.select("record_id", joined(found).alias("violations")).where("violations <> ''")


def question_violations(spark: SparkSession, directory: str) -> DataFrame:
    """Questions that break the contract of a question, a response or a claim, and how. Rows repeated in full count once."""
    t = read_table(spark, directory, "questions").select("suite_id", "question_id", "text", "expected_source_ids", "no_answer", "response").distinct()
    no_ids, no_claims = F.array().cast("array<string>"), F.array().cast("array<struct<text:string,citations:array<string>>>")
    expected, claims, answer = F.coalesce("expected_source_ids", no_ids), F.coalesce("response.claims", no_claims), F.col("response.answer")
    named = lambda c: F.coalesce(c.rlike("^[a-z0-9][a-z0-9._-]{0,63}\\z"), F.lit(False))
    repeats = lambda ids: F.size(F.array_distinct(ids)) < F.size(ids)
    bad_text = lambda c: is_blank(c) | (F.length(c) > 10_000)
    cited = lambda c: F.coalesce(c["citations"], no_ids)
    codes = {
        "question_id": ~named(F.col("question_id")),
        "text": bad_text(F.col("text")),
        "expected_source_ids": F.exists(expected, lambda x: ~named(x)),
        "repeated_expected_source": repeats(expected),
        "no_answer": F.col("no_answer").isNull(),
        "expectation": F.coalesce(F.col("no_answer") != (F.size(expected) == 0), F.lit(False)),
        "response": F.col("response").isNull(),
        "answer": answer.isNotNull() & bad_text(answer),
        "claims": F.col("response").isNotNull() & (answer.isNull() != (F.size(claims) == 0)),
        "claim_text": F.exists(claims, lambda c: bad_text(c["text"])),
        "citations": F.exists(claims, lambda c: (F.size(cited(c)) == 0) | F.exists(cited(c), lambda x: ~named(x))),
        "repeated_citation": F.exists(claims, lambda c: repeats(cited(c))),
    }
    found = F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in codes.items())))
    return t.select("suite_id", "question_id", joined(found).alias("violations")).where("violations <> ''")


def repeated_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Source and question ids that a suite has more than once, and how often; a contract allows each once."""
    kinds = {"source": ("source_docs", "source_id"), "question": ("questions", "question_id")}
    rows = [read_table(spark, directory, table).select(F.lit(kind).alias("kind"), "suite_id", F.col(column).alias("id")) for kind, (table, column) in kinds.items()]
    return reduce(DataFrame.unionByName, rows).where("id is not null").groupBy("kind", "suite_id", "id").agg(F.count("*").alias("n")).where("n > 1")


def unknown_expected_sources(spark: SparkSession, directory: str) -> DataFrame:
    t = Tables(spark, directory)
    named = t.asked.select("suite_id", "question_id", F.explode("expected").alias("source_id"))
    return named.join(t.documents, ["suite_id", "source_id"], "left_anti").select("suite_id", "question_id", "source_id")


def document_validation(spark: SparkSession, directory: str) -> DataFrame:
    return Tables(spark, directory).validated.select("suite_id", "source_id", "valid", joined("errors").alias("errors"))


def valid_documents(spark: SparkSession, directory: str) -> DataFrame:
    return Tables(spark, directory).valid.select("suite_id", "source_id")


def content_hashes(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "source_docs").select("record_id", content_sha256(F.col("content")).alias("content_sha256"))


def tokenize_documents(spark: SparkSession, directory: str) -> DataFrame:
    found = tokens(F.col("content"))
    return read_table(spark, directory, "source_docs").select("record_id", F.size(found).alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("tokens_md5"))


def chunk_counts(spark: SparkSession, directory: str) -> DataFrame:
    return corpus.chunk_counts(Tables(spark, directory).valid).select("suite_id", "source_id", "n_words", "n_chunks")


def chunk_documents(spark: SparkSession, directory: str) -> DataFrame:
    return Tables(spark, directory).chunks


def index_manifest_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return index.manifest_chunks(Tables(spark, directory).chunks)


def duplicate_documents(spark: SparkSession, directory: str) -> DataFrame:
    return corpus.duplicate_groups(Tables(spark, directory).documents).select("suite_id", "sha256", joined("source_ids").alias("source_ids"))


def inventory_summary(spark: SparkSession, directory: str) -> DataFrame:
    return corpus.inventory(Tables(spark, directory).validated).select("suite_id", "document_count", "valid_document_count", r6("fresh_coverage"))


def chunk_postings(spark: SparkSession, directory: str) -> DataFrame:
    return index.postings(Tables(spark, directory).chunks)


def document_frequency(spark: SparkSession, directory: str) -> DataFrame:
    return index.document_frequency(index.postings(Tables(spark, directory).chunks))


def index_stats(spark: SparkSession, directory: str) -> DataFrame:
    return index.index_stats(Tables(spark, directory).chunks).select("suite_id", "n_chunks", r6("avg_length"))


def term_idf(spark: SparkSession, directory: str) -> DataFrame:
    return Tables(spark, directory).index().terms.select("suite_id", "token", "df", r6("bm25_idf"), r6("tfidf_idf"))


def tfidf_norms(spark: SparkSession, directory: str) -> DataFrame:
    built = Tables(spark, directory).index()
    return index.tfidf_norms(built.posted, built.terms).select("suite_id", "chunk_id", r6("norm"))


def hashed_token_buckets(spark: SparkSession, directory: str) -> DataFrame:
    found = read_table(spark, directory, "source_docs").select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("token")).distinct()
    return found.select("token", hashed_bucket(F.col("token")).alias("bucket"), hashed_sign(F.col("token")).alias("sign"))


def hashed_vectors(spark: SparkSession, directory: str) -> DataFrame:
    built = Tables(spark, directory).index()
    return index.hashed_vectors(built.posted, built.terms, "suite_id", "chunk_id").select("suite_id", "chunk_id", "bucket", r6("w"))


def _top(strategy: str) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        rows = Tables(spark, directory).retrieved(strategy)
        return rows.select("suite_id", "question_id", "rank", "chunk_id", r6("score"), r6("lexical_score"), r6("vector_score"))

    return query


def _record(*columns: str) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        return Tables(spark, directory).records().select("suite_id", "question_id", *(r6(c) for c in columns))

    return query


def claim_support(spark: SparkSession, directory: str) -> DataFrame:
    t = Tables(spark, directory)
    return judging.claim_support(t.asked, t.valid).select("suite_id", "question_id", "claim_pos", r6("token_coverage"), "supported", joined("reasons").alias("reasons"))


def citation_errors(spark: SparkSession, directory: str, own: bool = False) -> DataFrame:
    return Tables(spark, directory).records(own=own).select("suite_id", "question_id", joined("citation_errors").alias("citation_errors"), "citations_valid")


def question_verdicts(spark: SparkSession, directory: str) -> DataFrame:
    return Tables(spark, directory).records().select("suite_id", "question_id", "no_answer_correct", "grounded", "passed", joined("failures").alias("failures"))


def question_records(spark: SparkSession, directory: str, own: bool = False) -> DataFrame:
    rows = Tables(spark, directory).records(own=own)
    measures = ("recall_at_k", "precision_at_k", "reciprocal_rank", "ndcg_at_k", "citation_precision", "citation_recall")
    return rows.select("suite_id", "question_id", "adversarial", joined("sources").alias("sources"), *(r6(m) for m in measures), "citations_valid", "no_answer_correct", "grounded", "passed", joined("failures").alias("failures"))


def suite_metrics(spark: SparkSession, directory: str, own: bool = False) -> DataFrame:
    t = Tables(spark, directory)
    rows = metrics.suite_metrics(t.records(own=own), corpus.inventory(t.validated))
    return rows.select("suite_id", *(r6(c) for c in rows.columns if c != "suite_id"))


def pass_rate_ci(spark: SparkSession, directory: str) -> DataFrame:
    return metrics.pass_rate_ci(Tables(spark, directory).records(own=True))


def compare_strategies(spark: SparkSession, directory: str) -> DataFrame:
    """Questions whose verdict or retrieved chunks differ between overlap and BM25."""
    t = Tables(spark, directory)
    built, sides = t.index(), []
    support = judging.claim_support(t.asked, t.valid)
    for strategy in ("overlap", "bm25"):
        hits = with_source(scoring.retrieve(strategy, built, t.suites))
        listed = hits.groupBy("suite_id", "question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.bround("score", 6).alias("score")))).alias("retrieved"))
        verdicts = judging.judge(t.questions, hits, t.valid, t.suites, support).select("suite_id", "question_id", "passed")
        sides.append(verdicts.join(listed, ["suite_id", "question_id"], "left"))
    return metrics.compare(*sides)


def sweep_grid(spark: SparkSession, directory: str) -> DataFrame:
    return sweep.grid(spark, ["overlap", "bm25", "tfidf"], [96, 200], [0, 16, 120])


def sweep_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Quality of each configuration for each suite, best first."""
    t = Tables(spark, directory)
    rows = sweep.run(t.documents, t.questions, t.suites, sweep.grid(spark, ["overlap", "bm25"], [96, 200], [16]))
    return rows.select("suite_id", "strategy", "chunk_size", "chunk_overlap", r6("pass_rate"), r6("recall_at_k"), r6("ndcg_at_k"), r6("quality_score"), "place")


def queries() -> dict[str, Query]:
    plain = (
        contract_violations, question_violations, repeated_ids, unknown_expected_sources, document_validation, valid_documents, content_hashes, tokenize_documents, chunk_counts, chunk_documents,
        index_manifest_chunks, duplicate_documents, inventory_summary, chunk_postings, document_frequency, index_stats, term_idf, tfidf_norms, hashed_token_buckets,
        hashed_vectors, claim_support, citation_errors, question_verdicts, question_records, suite_metrics, pass_rate_ci, compare_strategies, sweep_grid, sweep_runs,
    )
    return (
        {f.__name__: f for f in plain}
        | {f"topk_{s}": _top(s) for s in scoring.STRATEGIES}
        | {m: _record(m) for m in ("recall_at_k", "precision_at_k", "reciprocal_rank", "ndcg_at_k")}
        | {f"own_{f.__name__}": partial(f, own=True) for f in (question_records, suite_metrics, citation_errors)}
        | {"citation_scores": _record("citation_precision", "citation_recall")}
    )
