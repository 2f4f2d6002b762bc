"""DuckDB SQL that gives the same rows as the engine's queries."""

from __future__ import annotations

import re

_WORDS = r"[^\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

_BLANK = _WORDS.replace("[^", "[").removesuffix("+") + "*"
_ID = "[a-z0-9][a-z0-9._-]{0,63}"


def _tokens(text: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda t: length(t) > 1), lambda t: lower(t))"


_CTES = {
    "sources": "SELECT * FROM source_docs QUALIFY row_number() OVER (PARTITION BY suite_id, source_id ORDER BY doc_pos) = 1",
    "validated": """
  SELECT s.*, u.evaluation_date, u.chunk_size, u.chunk_overlap, list_filter([
    CASE WHEN sha256(s.content) IS DISTINCT FROM s.sha256 THEN 'hash_mismatch' END,
    CASE WHEN coalesce(s.trust, 'missing') <> 'trusted' THEN 'trust_' || coalesce(s.trust, 'missing') END,
    CASE WHEN s.observed_at > u.evaluation_date THEN 'observed_in_future' END,
    CASE WHEN s.expires_at < u.evaluation_date THEN 'expired' END], lambda x: x IS NOT NULL) AS errors
  FROM sources s JOIN suites u USING (suite_id)""",
    "valid": "SELECT * FROM validated WHERE len(errors) = 0",
    "worded": f"SELECT suite_id, source_id, sha256, chunk_size, chunk_overlap, regexp_extract_all(content, '{_WORDS}') AS w FROM valid",
    "counted": """
  SELECT *, len(w) AS n_words, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= chunk_size THEN 1
    ELSE 1 + (len(w) - chunk_size + chunk_size - chunk_overlap - 1) // (chunk_size - chunk_overlap) END AS n_chunks FROM worded""",
    "placed": """
  SELECT *, ordinal * (chunk_size - chunk_overlap) AS s, least(n_words, ordinal * (chunk_size - chunk_overlap) + chunk_size) AS e
  FROM (SELECT *, unnest(range(n_chunks)) AS ordinal FROM counted)""",
    "chunked": "SELECT suite_id, source_id || ':' || ordinal || ':' || s || '-' || e AS chunk_id, source_id, CAST(ordinal AS INTEGER) AS ordinal, array_to_string(w[s + 1:e], ' ') AS text, sha256 AS document_sha256 FROM placed",
    "tokenized": f"SELECT suite_id, chunk_id, {_tokens('text')} AS tokens FROM chunked",
    "posted": "SELECT suite_id, chunk_id, token, count(*) AS tf, any_value(n) AS length FROM (SELECT suite_id, chunk_id, len(tokens) AS n, unnest(tokens) AS token FROM tokenized) GROUP BY ALL",
    "stats": "SELECT suite_id, count(*) AS n_chunks, avg(len(tokens)) AS avg_length FROM tokenized GROUP BY suite_id",
    "terms": """
  SELECT suite_id, token, df, ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) AS bm25_idf, ln((n_chunks + 1) / (df + 1)) + 1 AS tfidf_idf
  FROM (SELECT suite_id, token, count(*) AS df FROM posted GROUP BY ALL) JOIN stats USING (suite_id)""",
    "asked": """
  SELECT DISTINCT suite_id, question_id, question_pos, text, list_distinct(coalesce(expected_source_ids, [])) AS expected, coalesce(no_answer, FALSE) AS no_answer,
    coalesce(adversarial, FALSE) AS adversarial, response.answer IS NULL AS abstained, coalesce(response.claims, []) AS claims,
    list_distinct(flatten(list_transform(coalesce(response.claims, []), lambda c: coalesce(c.citations, [])))) AS citations FROM questions""",
    "q": f"SELECT suite_id, question_id, token, count(*) AS qtf FROM (SELECT suite_id, question_id, unnest({_tokens('text')}) AS token FROM asked) GROUP BY ALL",
    "matched": """
  SELECT q.suite_id, question_id, chunk_id, token, qtf, tf, length, bm25_idf, tfidf_idf FROM q JOIN terms USING (suite_id, token) JOIN posted USING (suite_id, token)""",
    "s_overlap": """
  SELECT suite_id, question_id, chunk_id, count(*) / any_value(n) AS lexical_score, 0.0::DOUBLE AS vector_score
  FROM matched JOIN (SELECT suite_id, question_id, count(*) AS n FROM q GROUP BY ALL) USING (suite_id, question_id) GROUP BY suite_id, question_id, chunk_id""",
    "s_bm25": """
  SELECT suite_id, question_id, chunk_id, sum(bm25_idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))) AS lexical_score, 0.0::DOUBLE AS vector_score
  FROM matched JOIN stats USING (suite_id) GROUP BY suite_id, question_id, chunk_id""",
    "norms": "SELECT suite_id, chunk_id, sqrt(sum((tf * tfidf_idf) ** 2)) AS norm FROM posted JOIN terms USING (suite_id, token) GROUP BY ALL",
    "s_tfidf": """
  SELECT suite_id, question_id, chunk_id, sum(qtf * tfidf_idf * tf * tfidf_idf) / (any_value(qnorm) * any_value(norm)) AS lexical_score, 0.0::DOUBLE AS vector_score
  FROM matched JOIN norms USING (suite_id, chunk_id)
  JOIN (SELECT suite_id, question_id, sqrt(sum((qtf * tfidf_idf) ** 2)) AS qnorm FROM q JOIN terms USING (suite_id, token) GROUP BY ALL) USING (suite_id, question_id)
  GROUP BY suite_id, question_id, chunk_id""",
    "hashed": """
  SELECT token, CAST(('0x' || substr(sha256(token), 1, 8))::BIGINT % 128 AS INTEGER) AS bucket, CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign
  FROM (SELECT token FROM posted UNION SELECT token FROM q)""",
    "chunk_vectors": "SELECT suite_id, chunk_id, bucket, sum(sign * tf * tfidf_idf) AS w FROM posted JOIN terms USING (suite_id, token) JOIN hashed USING (token) GROUP BY ALL",
    "question_vectors": "SELECT suite_id, question_id, bucket, sum(sign * qtf * coalesce(tfidf_idf, 1.0)) AS w FROM q LEFT JOIN terms USING (suite_id, token) JOIN hashed USING (token) GROUP BY ALL",
    "s_hashing": """
  SELECT suite_id, question_id, chunk_id, 0.0::DOUBLE AS lexical_score, greatest(0.0, sum(a.w * b.w) / (any_value(qn) * any_value(cn))) AS vector_score
  FROM question_vectors a JOIN chunk_vectors b USING (suite_id, bucket)
  JOIN (SELECT suite_id, question_id, sqrt(sum(w * w)) AS qn FROM question_vectors GROUP BY ALL HAVING qn > 0) USING (suite_id, question_id)
  JOIN (SELECT suite_id, chunk_id, sqrt(sum(w * w)) AS cn FROM chunk_vectors GROUP BY ALL HAVING cn > 0) USING (suite_id, chunk_id)
  GROUP BY suite_id, question_id, chunk_id""",
    "s_hybrid": """
  SELECT suite_id, question_id, chunk_id, coalesce(l.lexical_score, 0) AS lexical_score, coalesce(v.vector_score, 0) AS vector_score
  FROM s_bm25 l FULL JOIN (SELECT * FROM s_hashing WHERE vector_score > 0) v USING (suite_id, question_id, chunk_id)""",
}

_SCORES = {"overlap": "lexical_score", "bm25": "lexical_score", "tfidf": "lexical_score", "hashing": "vector_score", "hybrid": "hybrid_weight * lexical_score / (1 + lexical_score) + (1 - hybrid_weight) * vector_score"}


def _top(strategy: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, regexp_extract(chunk_id, '^(.*):\\d+:\\d+-\\d+$', 1) AS source_id FROM (
    SELECT s.suite_id, question_id, chunk_id, {_SCORES[strategy]} AS score, lexical_score, vector_score, retrieval_k,
      row_number() OVER (PARTITION BY s.suite_id, question_id ORDER BY round({_SCORES[strategy]}, 9) DESC, chunk_id) AS rank
    FROM s_{strategy} s JOIN suites USING (suite_id) WHERE round({_SCORES[strategy]}, 9) > 0)
  WHERE rank <= retrieval_k)"""


_SUPPORT = f"""
claims AS (
  SELECT suite_id, question_id, CAST(pos - 1 AS INTEGER) AS claim_pos, coalesce(c.citations, []) AS citations, list_distinct({_tokens('c.text')}) AS tokens
  FROM (SELECT suite_id, question_id, unnest(claims) AS c, generate_subscripts(claims, 1) AS pos FROM asked)
), evidence AS (
  SELECT c.suite_id, question_id, claim_pos, list_filter(any_value(citations), lambda x: NOT list_contains(coalesce(list(v.source_id) FILTER (WHERE v.source_id IS NOT NULL), []), x)) AS missing,
    coalesce(flatten(list({_tokens('v.content')}) FILTER (WHERE v.source_id IS NOT NULL)), []) AS there
  FROM (SELECT suite_id, question_id, claim_pos, citations, unnest(CASE WHEN len(citations) = 0 THEN [NULL] ELSE citations END) AS cited FROM claims) c
  LEFT JOIN valid v ON v.suite_id = c.suite_id AND v.source_id = c.cited GROUP BY c.suite_id, question_id, claim_pos
), covered AS (
  SELECT *, CASE WHEN len(tokens) = 0 OR len(missing) > 0 THEN 0.0 ELSE len(list_intersect(tokens, there)) / len(tokens) END AS coverage FROM claims JOIN evidence USING (suite_id, question_id, claim_pos)
), support AS (
  SELECT suite_id, question_id, claim_pos, coverage, CASE WHEN len(tokens) = 0 THEN ['empty_claim'] WHEN len(missing) > 0 THEN list_transform(missing, lambda x: 'missing_source:' || x)
    WHEN coverage < 0.75 THEN ['claim_not_supported'] ELSE [] END AS reasons FROM covered
)"""


def _judged(top: str = "top", prefix: str = "") -> str:
    p = prefix
    return f"""
{p}sourced AS (
  SELECT a.*, coalesce(r.sources, []) AS sources FROM asked a
  LEFT JOIN (SELECT suite_id, question_id, list(source_id ORDER BY rank) AS sources FROM {top} GROUP BY ALL) r USING (suite_id, question_id)
), {p}known AS (
  SELECT s.suite_id, s.question_id, list(v.source_id) AS valid
  FROM (SELECT suite_id, question_id, unnest(list_distinct(list_concat(expected, citations))) AS source_id FROM {p}sourced) s JOIN valid v USING (suite_id, source_id) GROUP BY ALL
), {p}joined AS (
  SELECT s.*, coalesce(k.valid, []) AS valid, retrieval_k, coalesce(n_claims, 0) AS n_claims, coalesce(n_supported, 0) AS n_supported,
    list_intersect(list_distinct(sources), expected) AS hits
  FROM {p}sourced s LEFT JOIN {p}known k USING (suite_id, question_id) JOIN suites USING (suite_id)
  LEFT JOIN (SELECT suite_id, question_id, count(*) AS n_claims, count(*) FILTER (WHERE len(reasons) = 0) AS n_supported FROM support GROUP BY ALL) USING (suite_id, question_id)
), {p}measured AS (
  SELECT *, CASE WHEN len(expected) = 0 THEN 1.0 ELSE len(hits) / len(expected) END AS recall_at_k,
    CASE WHEN len(sources) = 0 THEN CASE WHEN len(expected) = 0 THEN 1.0 ELSE 0.0 END ELSE len(hits) / len(sources) END AS precision_at_k,
    CASE WHEN len(expected) = 0 THEN 1.0 WHEN len(hits) = 0 THEN 0.0 ELSE 1.0 / list_min(list_transform(hits, lambda x: list_position(sources, x))) END AS reciprocal_rank,
    CASE WHEN len(expected) = 0 THEN 1.0 ELSE coalesce(list_sum(list_transform(hits, lambda x: 1 / log2(list_position(sources, x) + 1))), 0)
      / list_sum(list_transform(range(1, least(len(expected), retrieval_k) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_at_k,
    CASE WHEN len(citations) > 0 THEN len(list_intersect(citations, list_intersect(hits, valid))) / len(citations) WHEN len(expected) = 0 THEN 1.0 ELSE 0.0 END AS citation_precision,
    CASE WHEN len(expected) = 0 THEN 1.0 ELSE len(list_intersect(citations, list_intersect(hits, valid))) / len(expected) END AS citation_recall,
    list_sort(list_filter(citations, lambda x: NOT list_contains(sources, x))) AS citation_errors,
    len(list_filter(citations, lambda x: NOT list_contains(sources, x) OR NOT list_contains(valid, x))) = 0 AS citations_valid,
    abstained = no_answer AS no_answer_correct,
    CASE WHEN n_claims > 0 THEN n_supported = n_claims ELSE no_answer AND abstained END AS grounded
  FROM {p}joined
), {p}records AS (
  SELECT *, list_filter([CASE WHEN recall_at_k < 1 THEN 'retrieval_miss' END, CASE WHEN NOT citations_valid THEN 'invalid_citation' END,
    CASE WHEN NOT no_answer_correct THEN 'no_answer_mismatch' END, CASE WHEN NOT grounded THEN 'ungrounded_claim' END], lambda x: x IS NOT NULL) AS failures, len(failures) = 0 AS passed
  FROM {p}measured
)"""


def _with(last: str, *more: str, upto: str | None = None) -> str:
    names = list(_CTES)
    names = names[: names.index(upto) + 1] if upto else names
    parts = [f"{n} AS ({_CTES[n]})" for n in names] + [m.strip() for m in more]
    return "WITH " + ",\n".join(parts) + "\n" + last


def _record(columns: str) -> str:
    return _with(f"SELECT suite_id, question_id, {columns} FROM records", _top("bm25", "top"), _SUPPORT, _judged())


def _r6(*names: str) -> str:
    return ", ".join(f"round_even(round({n}, 12), 6) + 0.0::DOUBLE AS {n}" for n in names)


_METRICS = """
  SELECT suite_id, coalesce(avg(recall_at_k) FILTER (WHERE NOT no_answer), 1.0) AS recall_at_k,
    coalesce(avg(round_even(precision_at_k, 6)) FILTER (WHERE NOT no_answer), 1.0) AS precision_at_k,
    coalesce(avg(round_even(reciprocal_rank, 6)) FILTER (WHERE NOT no_answer), 1.0) AS mean_reciprocal_rank,
    coalesce(avg(round_even(ndcg_at_k, 6)) FILTER (WHERE NOT no_answer), 1.0) AS ndcg_at_k,
    CASE WHEN sum(n_claims) > 0 THEN sum(n_supported) / sum(n_claims) ELSE 1.0 END AS groundedness,
    coalesce(avg(round_even(citation_precision, 6)) FILTER (WHERE NOT no_answer), 1.0) AS citation_precision,
    coalesce(avg(round_even(citation_recall, 6)) FILTER (WHERE NOT no_answer), 1.0) AS citation_recall,
    coalesce(avg(CAST(no_answer_correct AS DOUBLE)) FILTER (WHERE no_answer), 1.0) AS no_answer_accuracy,
    avg(CAST(passed AS DOUBLE)) AS pass_rate, coalesce(avg(CAST(passed AS DOUBLE)) FILTER (WHERE adversarial), 1.0) AS adversarial_pass_rate
  FROM {records} GROUP BY suite_id"""
_INVENTORY = "SELECT suite_id, count(*) AS document_count, count(*) FILTER (WHERE len(errors) = 0) AS valid_document_count, count(*) FILTER (WHERE len(errors) = 0) / count(*) AS fresh_coverage FROM validated GROUP BY suite_id"


def _sweep() -> str:
    """The whole pipeline once for each configuration, side by side."""
    names = list(_CTES)
    parts, rows = [], []
    shared = ("sources", "validated", "valid", "asked", "q")
    for n in shared:
        parts.append(f"{n} AS ({_CTES[n]})")
    parts.append(_SUPPORT.strip())
    for size in (96, 200):
        own = [n for n in names[names.index("worded") : names.index("s_bm25") + 1] if n not in shared]
        rename = lambda sql, own=own, size=size: re.sub(rf"\b({'|'.join(own)})\b", rf"\1_{size}", sql)
        for n in own:
            sql = _CTES[n]
            if n == "worded":
                sql = sql.replace("chunk_size, chunk_overlap", f"{size} AS chunk_size, 16 AS chunk_overlap")
            parts.append(f"{n}_{size} AS ({rename(sql)})")
        for strategy in ("overlap", "bm25"):
            p = f"r_{size}_{strategy}_"
            parts.append(rename(_top(strategy, f"top_{size}_{strategy}")))
            parts.append(_judged(f"top_{size}_{strategy}", p).strip())
            rows.append(f"SELECT '{strategy}' AS strategy, {size} AS chunk_size, 16 AS chunk_overlap, * FROM ({_METRICS.format(records=f'{p}records')})")
    return "WITH " + ",\n".join(parts) + f""", runs AS ({" UNION ALL ".join(rows)}), scored AS (
  SELECT *, round_even(round(0.4 * pass_rate + 0.2 * recall_at_k + 0.15 * ndcg_at_k + 0.15 * groundedness + 0.1 * no_answer_accuracy, 12), 6) AS quality_score FROM runs)
SELECT suite_id, strategy, chunk_size, chunk_overlap, {_r6('pass_rate', 'recall_at_k', 'ndcg_at_k')}, quality_score,
  CAST(row_number() OVER (PARTITION BY suite_id ORDER BY quality_score DESC, round(pass_rate, 9) DESC, round(recall_at_k, 9) DESC, strategy, chunk_size, chunk_overlap) AS INTEGER) AS place FROM scored"""


def oracle_sql() -> dict[str, str]:
    out = {
        "contract_violations": r"""
SELECT * FROM (SELECT record_id, array_to_string(list_filter([
  CASE WHEN NOT coalesce(regexp_full_match(source_id, '[a-z0-9][a-z0-9._-]{0,63}'), FALSE) THEN 'source_id' END,
  CASE WHEN coalesce(regexp_full_match(title, '{BLANK}'), TRUE) OR length(title) > 200 THEN 'title' END,
  CASE WHEN coalesce(regexp_full_match(source_url, '{BLANK}'), TRUE) OR length(source_url) > 500 THEN 'source_url' END,
  CASE WHEN coalesce(regexp_full_match(license, '{BLANK}'), TRUE) OR length(license) > 100 THEN 'license' END,
  CASE WHEN NOT coalesce(trust IN ('trusted', 'untrusted', 'blocked'), FALSE) THEN 'trust' END,
  CASE WHEN observed_at IS NULL THEN 'observed_at' END,
  CASE WHEN coalesce(regexp_full_match(content, '{BLANK}'), TRUE) OR length(content) > 200000 THEN 'content' END,
  CASE WHEN NOT coalesce(regexp_full_match(sha256, '[0-9a-f]{64}'), FALSE) THEN 'sha256' END], lambda x: x IS NOT NULL), ',') AS violations FROM source_docs)
WHERE violations <> ''""".replace("{BLANK}", _BLANK),
        "question_violations": rf"""
WITH q AS (
  SELECT suite_id, question_id, text, coalesce(expected_source_ids, []) AS expected, no_answer, response, response.answer AS answer, coalesce(response.claims, []) AS claims
  FROM (SELECT DISTINCT suite_id, question_id, text, expected_source_ids, no_answer, response FROM questions)
)
SELECT * FROM (SELECT suite_id, question_id, array_to_string(list_filter([
  CASE WHEN NOT coalesce(regexp_full_match(question_id, '{_ID}'), FALSE) THEN 'question_id' END,
  CASE WHEN coalesce(regexp_full_match(text, '{_BLANK}'), TRUE) OR length(text) > 10000 THEN 'text' END,
  CASE WHEN len(list_filter(expected, lambda x: NOT coalesce(regexp_full_match(x, '{_ID}'), FALSE))) > 0 THEN 'expected_source_ids' END,
  CASE WHEN len(list_distinct(expected)) < len(expected) THEN 'repeated_expected_source' END,
  CASE WHEN no_answer IS NULL THEN 'no_answer' END,
  CASE WHEN no_answer <> (len(expected) = 0) THEN 'expectation' END,
  CASE WHEN response IS NULL THEN 'response' END,
  CASE WHEN answer IS NOT NULL AND (regexp_full_match(answer, '{_BLANK}') OR length(answer) > 10000) THEN 'answer' END,
  CASE WHEN response IS NOT NULL AND (answer IS NULL) <> (len(claims) = 0) THEN 'claims' END,
  CASE WHEN len(list_filter(claims, lambda c: coalesce(regexp_full_match(c.text, '{_BLANK}'), TRUE) OR length(c.text) > 10000)) > 0 THEN 'claim_text' END,
  CASE WHEN len(list_filter(claims, lambda c: len(coalesce(c.citations, [])) = 0 OR len(list_filter(c.citations, lambda x: NOT coalesce(regexp_full_match(x, '{_ID}'), FALSE))) > 0)) > 0 THEN 'citations' END,
  CASE WHEN len(list_filter(claims, lambda c: len(list_distinct(coalesce(c.citations, []))) < len(coalesce(c.citations, [])))) > 0 THEN 'repeated_citation' END
  ], lambda x: x IS NOT NULL), ',') AS violations FROM q) WHERE violations <> ''""",
        "repeated_ids": """
SELECT kind, suite_id, id, count(*) AS n FROM (SELECT 'source' AS kind, suite_id, source_id AS id FROM source_docs UNION ALL SELECT 'question', suite_id, question_id FROM questions)
WHERE id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
        "unknown_expected_sources": f"WITH sources AS ({_CTES['sources']}), asked AS ({_CTES['asked']}) SELECT suite_id, question_id, source_id FROM (SELECT suite_id, question_id, unnest(expected) AS source_id FROM asked) ANTI JOIN sources USING (suite_id, source_id)",
        "document_validation": _with("SELECT suite_id, source_id, len(errors) = 0 AS valid, array_to_string(errors, ',') AS errors FROM validated", upto="validated"),
        "valid_documents": _with("SELECT suite_id, source_id FROM valid", upto="valid"),
        "content_hashes": "SELECT record_id, sha256(content) AS content_sha256 FROM source_docs",
        "tokenize_documents": f"SELECT record_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT record_id, {_tokens('content')} AS t FROM source_docs)",
        "chunk_counts": _with("SELECT suite_id, source_id, CAST(n_words AS INTEGER) AS n_words, CAST(n_chunks AS INTEGER) AS n_chunks FROM counted", upto="counted"),
        "chunk_documents": _with("SELECT * FROM chunked", upto="chunked"),
        "index_manifest_chunks": _with(f"SELECT suite_id, chunk_id, source_id, ordinal, document_sha256, sha256(text) AS text_sha256, CAST(len({_tokens('text')}) AS INTEGER) AS token_count FROM chunked", upto="chunked"),
        "duplicate_documents": _with("SELECT suite_id, sha256, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS source_ids FROM sources WHERE sha256 IS NOT NULL GROUP BY suite_id, sha256 HAVING count(DISTINCT source_id) > 1", upto="sources"),
        "inventory_summary": _with(f"SELECT suite_id, document_count, valid_document_count, {_r6('fresh_coverage')} FROM ({_INVENTORY})", upto="validated"),
        "chunk_postings": _with("SELECT suite_id, chunk_id, token, CAST(tf AS INTEGER) AS tf, CAST(length AS INTEGER) AS length FROM posted", upto="posted"),
        "document_frequency": _with("SELECT suite_id, token, count(*) AS df FROM posted GROUP BY ALL", upto="posted"),
        "index_stats": _with(f"SELECT suite_id, n_chunks, {_r6('avg_length')} FROM stats", upto="stats"),
        "term_idf": _with(f"SELECT suite_id, token, df, {_r6('bm25_idf', 'tfidf_idf')} FROM terms", upto="terms"),
        "tfidf_norms": _with(f"SELECT suite_id, chunk_id, {_r6('norm')} FROM norms"),
        "hashed_token_buckets": f"""SELECT token, CAST(('0x' || substr(sha256(token), 1, 8))::BIGINT % 128 AS INTEGER) AS bucket, CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign
FROM (SELECT DISTINCT unnest({_tokens('content')}) AS token FROM source_docs)""",
        "hashed_vectors": _with(f"SELECT suite_id, chunk_id, bucket, {_r6('w')} FROM chunk_vectors"),
        "claim_support": _with("SELECT suite_id, question_id, claim_pos, round_even(round(coverage, 12), 6) + 0.0::DOUBLE AS token_coverage, len(reasons) = 0 AS supported, array_to_string(reasons, ',') AS reasons FROM support", _SUPPORT),
        "citation_errors": _record("array_to_string(citation_errors, ',') AS citation_errors, citations_valid"),
        "question_verdicts": _record("no_answer_correct, grounded, passed, array_to_string(failures, ',') AS failures"),
        "question_records": _record(f"adversarial, array_to_string(sources, ',') AS sources, {_r6('recall_at_k', 'precision_at_k', 'reciprocal_rank', 'ndcg_at_k', 'citation_precision', 'citation_recall')}, citations_valid, no_answer_correct, grounded, passed, array_to_string(failures, ',') AS failures"),
        "citation_scores": _record(_r6("citation_precision", "citation_recall")),
        "suite_metrics": _with(
            f"SELECT suite_id, {_r6('recall_at_k', 'precision_at_k', 'mean_reciprocal_rank', 'ndcg_at_k', 'groundedness', 'citation_precision', 'citation_recall', 'no_answer_accuracy', 'pass_rate', 'adversarial_pass_rate', 'fresh_coverage')} FROM ({_METRICS.format(records='records')}) JOIN ({_INVENTORY}) USING (suite_id)",
            _top("bm25", "top"), _SUPPORT, _judged(),
        ),
        "compare_strategies": _with(
            """SELECT suite_id, question_id, a.passed AS baseline_passed, b.passed AS candidate_passed FROM o_records a FULL JOIN b_records b USING (suite_id, question_id)
LEFT JOIN (SELECT suite_id, question_id, list((rank, chunk_id, round_even(score, 6)) ORDER BY rank) AS r FROM top_o GROUP BY ALL) x USING (suite_id, question_id)
LEFT JOIN (SELECT suite_id, question_id, list((rank, chunk_id, round_even(score, 6)) ORDER BY rank) AS r FROM top_b GROUP BY ALL) y USING (suite_id, question_id)
WHERE a.passed IS DISTINCT FROM b.passed OR x.r IS DISTINCT FROM y.r""",
            _top("overlap", "top_o"), _top("bm25", "top_b"), _SUPPORT, _judged("top_o", "o_"), _judged("top_b", "b_"),
        ),
        "sweep_grid": "SELECT strategy, chunk_size, chunk_overlap FROM (SELECT unnest(['overlap', 'bm25', 'tfidf']) AS strategy), (SELECT unnest([96, 200]) AS chunk_size), (SELECT unnest([0, 16, 120]) AS chunk_overlap) WHERE chunk_overlap < chunk_size",
        "sweep_runs": _sweep(),
    }
    for strategy in _SCORES:
        out[f"topk_{strategy}"] = _with(f"SELECT suite_id, question_id, CAST(rank AS INTEGER) AS rank, chunk_id, {_r6('score', 'lexical_score', 'vector_score')} FROM top", _top(strategy, "top"))
    for name in ("recall_at_k", "precision_at_k", "reciprocal_rank", "ndcg_at_k"):
        out[name] = _record(_r6(name))
    # The same over what each suite's own strategy finds.
    tops = [_top(s, f"top_{s}") for s in _SCORES]
    own = "top AS (" + " UNION ALL ".join(f"SELECT t.* FROM top_{s} t JOIN suites u USING (suite_id) WHERE coalesce(u.retrieval_strategy, 'overlap') = '{s}'" for s in _SCORES) + ")"
    for name in ("question_records", "suite_metrics", "citation_errors"):
        out[f"own_{name}"] = out[name].replace(_top("bm25", "top").strip(), ",\n".join([*tops, own]))
    return out
