"""Schemas of the tables an evaluation reads. Every table carries `suite_id`; one run may evaluate any number of suites."""

DOCUMENTS = "suite_id string, doc_pos int, source_id string, title string, source_url string, license string, observed_at date, expires_at date, trust string, content string, sha256 string"
QUESTIONS = "suite_id string, question_pos int, question_id string, text string, expected_source_ids array<string>, no_answer boolean, adversarial boolean, response struct<answer: string, claims: array<struct<text: string, citations: array<string>>>>"
SUITES = "suite_id string, schema_version string, version string, evaluation_date date, chunk_size int, chunk_overlap int, retrieval_k int, retrieval_strategy string, hybrid_weight double"

STRATEGIES = ("overlap", "bm25", "tfidf", "hybrid")
TRUST_STATES = ("trusted", "untrusted", "blocked")

# Versions of suites and reports, and what is judged.
SUITE_VERSIONS = ("1.0",)
REPORT_VERSIONS = ("1.0", "2.0")
JUDGES = ("retrieval", "citation", "groundedness", "no_answer")
