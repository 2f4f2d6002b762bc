"""Verifying manifests and reports without the suite they came from.

First the shape of the artifact is held against a description of it; then everything in it that follows from something
else in it is derived again and compared; last comes its hash.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable
from typing import Any

from evalloom import schemas
from evalloom.operators.metrics import ITERATIONS, SEED
from evalloom.plans.evaluator import aggregate, semantic_sha256
from evalloom.sources.contract import DIGEST, IDENTIFIER, MAX_DOCUMENTS, MAX_INDEX_CHUNKS, MAX_QUESTIONS, SEMVER, canonical_sha256, is_number

Shape = Callable[[Any], bool]
# The codes a document's errors and a question's failures may have.
DOCUMENT_ERRORS = ("hash_mismatch", "trust_untrusted", "trust_blocked", "observed_in_future", "expired")
FAILURES = ("retrieval_miss", "invalid_citation", "no_answer_mismatch", "ungrounded_claim")


class _Broken(Exception):
    """Something in an artifact contradicts the rest of it."""


def _need(condition: bool) -> None:
    if not condition:
        raise _Broken


def _matches(pattern) -> Shape:
    return lambda v: isinstance(v, str) and pattern.fullmatch(v) is not None


def _number(low: float = -math.inf, high: float = math.inf) -> Shape:
    return lambda v: is_number(v, low, high)


def _whole(low: int, high: float = math.inf) -> Shape:
    return lambda v: type(v) is int and low <= v <= high


def _among(*values: Any) -> Shape:
    return lambda v: v in values


def _text(limit: float = math.inf, blank: bool = False) -> Shape:
    return lambda v: isinstance(v, str) and len(v) <= limit and (blank or bool(v.strip()))


def _items(shape: Shape, low: int = 0, high: float = math.inf, key: Callable | None = None) -> Shape:
    """A list of such items, different ones if `key` tells them apart."""

    def check(v: Any) -> bool:
        if not isinstance(v, list) or not low <= len(v) <= high or not all(map(shape, v)):
            return False
        return key is None or len({key(x) for x in v}) == len(v)

    return check


def _fields(**shapes: Shape) -> Shape:
    return lambda v: isinstance(v, dict) and set(v) == set(shapes) and all(shape(v[k]) for k, shape in shapes.items())


def _flag(v: Any) -> bool:
    return type(v) is bool


_id, _digest, _ratio = _matches(IDENTIFIER), _matches(DIGEST), _number(0, 1)
_same = lambda x: x
_MANIFEST = _fields(
    index_version=_among("1.0"), suite_sha256=_digest, strategy=_among(*schemas.STRATEGIES), hybrid_weight=_ratio, chunk_size=_whole(8, 500), chunk_overlap=_whole(0, 499), chunk_count=_whole(0, MAX_INDEX_CHUNKS), manifest_sha256=_digest,
    chunks=_items(_fields(chunk_id=_text(512), source_id=_text(64), ordinal=_whole(0), document_sha256=_digest, text_sha256=_digest, token_count=_whole(0)), key=lambda c: c["chunk_id"]),
)
_INVENTORY = _fields(
    suite_sha256=_digest, document_count=_whole(1, MAX_DOCUMENTS), valid_document_count=_whole(0, MAX_DOCUMENTS), fresh_coverage=_ratio, duplicates=_items(_items(_id)),
    documents=_items(_fields(source_id=_id, sha256=_digest, valid=_flag, errors=_items(_among(*DOCUMENT_ERRORS), key=_same)), 1, MAX_DOCUMENTS, lambda d: d["source_id"]),
)
_METRICS = _fields(
    **dict.fromkeys(("recall_at_k", "precision_at_k", "mean_reciprocal_rank", "ndcg_at_k", "groundedness", "citation_precision", "citation_recall", "no_answer_accuracy", "fresh_coverage", "pass_rate", "adversarial_pass_rate"), _ratio),
    pass_rate_ci95=_fields(mean=_ratio, lower=_ratio, upper=_ratio, iterations=_among(ITERATIONS), seed=_among(SEED)), mean_retrieval_latency_ms=_number(0), retrieval_k=_whole(1, 20), retrieval_strategy=_among(*schemas.STRATEGIES),
)
_CLAIM = _fields(text=_text(), citations=_items(_id, 1, key=_same), supported=_flag, token_coverage=_ratio, reasons=_items(_text(), key=_same))
_HIT = _fields(score=_number(0), lexical_score=_number(0), vector_score=_number(0), chunk_id=_text(512), source_id=_id, ordinal=_whole(0), text=_text(blank=True), document_sha256=_digest)
_RECORD = _fields(
    question_id=_id, adversarial=_flag, expected_source_ids=_items(_id, key=_same), retrieved=_items(_HIT, 0, 20, lambda h: h["chunk_id"]), retrieval_strategy=_among(*schemas.STRATEGIES), retrieval_latency_ms=_number(0),
    **dict.fromkeys(("recall_at_k", "precision_at_k", "reciprocal_rank", "ndcg_at_k", "citation_precision", "citation_recall"), _ratio),
    no_answer_correct=_flag, citations_valid=_flag, citation_errors=_items(_id), claims=_items(_CLAIM), grounded=_flag, passed=_flag, failures=_items(_among(*FAILURES), key=_same),
)
_REPORT = _fields(
    schema_version=_among("2.0"), suite_id=_id, suite_version=_matches(SEMVER), suite_sha256=_digest, index_sha256=_digest, index_manifest=_MANIFEST, inventory=_INVENTORY, metrics=_METRICS, records=_items(_RECORD, 1, MAX_QUESTIONS, lambda r: r["question_id"]), semantic_sha256=_digest,
)
_LEGACY_RECORD: Shape = lambda r: isinstance(r, dict) and _id(r.get("question_id")) and _items(_text(blank=True))(r.get("failures"))
_LEGACY = _fields(
    schema_version=_among("1.0"), suite_id=_id, suite_version=_matches(SEMVER), suite_sha256=_digest, index_sha256=_digest, inventory=lambda v: isinstance(v, dict), metrics=lambda v: isinstance(v, dict), records=_items(_LEGACY_RECORD, 1, MAX_QUESTIONS, lambda r: r["question_id"]), semantic_sha256=_digest,
)


def _close(a: Any, b: Any) -> bool:
    """Equal, numbers to twelve digits after the point."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_close(a[k], b[k]) for k in a)
    if is_number(a) and is_number(b):
        return abs(a - b) <= 1e-12
    return type(a) is type(b) and a == b


def derived_record(hits: list[str], expected: list[str], citations: set[str], valid: set[str], claims: list[dict], k: int) -> dict:
    """What follows for a record from the sources it retrieved, expected and cited."""
    wanted, first = set(expected), {}
    for place, source in enumerate(hits[:k], 1):
        if source in wanted:
            first.setdefault(source, place)
    gains = sum(1 / math.log2(p + 1) for p in first.values())
    ideal = sum(1 / math.log2(p + 1) for p in range(1, min(len(wanted), k) + 1))
    right = citations & wanted & valid & set(hits)
    by = lambda part, whole, none: part / whole if whole else none
    unanswerable = not wanted
    errors = sorted(citations - set(hits))
    out = {
        "recall_at_k": by(len(first), len(wanted), 1.0), "precision_at_k": round(by(len(first), len(hits[:k]), float(unanswerable)), 6), "reciprocal_rank": round(1.0 if unanswerable else by(1, min(first.values(), default=0), 0.0), 6), "ndcg_at_k": round(by(gains, ideal, 1.0), 6),
        "citation_precision": round(by(len(right), len(citations), float(unanswerable)), 6), "citation_recall": round(by(len(right), len(wanted), 1.0), 6), "citation_errors": errors, "citations_valid": not errors and citations <= valid,
        "no_answer_correct": unanswerable == (not claims), "grounded": all(c["supported"] for c in claims) if claims else unanswerable,
    }
    fine = (out["recall_at_k"] == 1, out["citations_valid"], out["no_answer_correct"], out["grounded"])
    return out | {"failures": [code for code, ok in zip(FAILURES, fine, strict=True) if not ok], "passed": all(fine)}


def _sound_manifest(manifest: Any) -> None:
    _need(_MANIFEST(manifest))
    _need(manifest["chunk_overlap"] < manifest["chunk_size"] and manifest["chunk_count"] == len(manifest["chunks"]))
    _need(manifest["manifest_sha256"] == canonical_sha256({k: v for k, v in manifest.items() if k != "manifest_sha256"}))


def _sound_inventory(inventory: dict) -> None:
    documents = inventory["documents"]
    by_hash = defaultdict(list)
    for d in documents:
        _need(d["valid"] == (not d["errors"]))
        by_hash[d["sha256"]].append(d["source_id"])
    n, valid = len(documents), sum(d["valid"] for d in documents)
    own = {"document_count": n, "valid_document_count": valid, "fresh_coverage": valid / n, "duplicates": sorted(sorted(ids) for ids in by_hash.values() if len(ids) > 1)}
    _need(_close(own, {k: inventory[k] for k in own}))


def _sound_record(record: dict, report: dict, documents: dict[str, dict], chunks: dict[str, dict]) -> None:
    metrics, hits = report["metrics"], record["retrieved"]
    _need(set(record["expected_source_ids"]) <= documents.keys() and record["retrieval_strategy"] == metrics["retrieval_strategy"] and len(hits) <= metrics["retrieval_k"])
    scores = [h["score"] for h in hits]
    _need(all(s > 0 for s in scores) and scores == sorted(scores, reverse=True))
    for hit in hits:
        listed = chunks.get(hit["chunk_id"])
        own = {k: hit[k] for k in ("source_id", "ordinal", "document_sha256")} | {"text_sha256": hashlib.sha256(hit["text"].encode("utf-8", "surrogatepass")).hexdigest()}
        _need(listed is not None and all(listed[k] == v for k, v in own.items()))
    for claim in record["claims"]:
        _need(bool(claim["reasons"]) != claim["supported"] and (not claim["supported"] or claim["token_coverage"] >= 0.75))
    valid = {s for s, d in documents.items() if d["valid"]}
    cited = {c for claim in record["claims"] for c in claim["citations"]}
    own = derived_record([h["source_id"] for h in hits], record["expected_source_ids"], cited, valid, record["claims"], metrics["retrieval_k"])
    _need(_close(own, {k: record[k] for k in own}))


def _sound_report(report: dict) -> None:
    manifest, inventory = report["index_manifest"], report["inventory"]
    _sound_manifest(manifest)
    _sound_inventory(inventory)
    _need(report["suite_sha256"] == manifest["suite_sha256"] == inventory["suite_sha256"] and report["index_sha256"] == manifest["manifest_sha256"] and report["metrics"]["retrieval_strategy"] == manifest["strategy"])
    documents = {d["source_id"]: d for d in inventory["documents"]}
    _need({c["source_id"] for c in manifest["chunks"]} == {s for s, d in documents.items() if d["valid"]})
    _need(all(c["document_sha256"] == documents[c["source_id"]]["sha256"] for c in manifest["chunks"]))
    chunks = {c["chunk_id"]: c for c in manifest["chunks"]}
    for record in report["records"]:
        _sound_record(record, report, documents, chunks)
    own = aggregate(report["records"], [not r["expected_source_ids"] for r in report["records"]], inventory["fresh_coverage"])
    _need(_close(own, {k: report["metrics"][k] for k in own}))
    _need(report["semantic_sha256"] == semantic_sha256(report))


def manifest_ok(manifest: Any) -> bool:
    try:
        _sound_manifest(manifest)
    except (_Broken, OverflowError, TypeError, ValueError):
        return False
    return True


def report_ok(report: Any) -> bool:
    """Whether a report of schema 2.0 is sound, or one of the older schema 1.0 has the right shape and hash."""
    try:
        if isinstance(report, dict) and report.get("schema_version") == "1.0":
            _need(_LEGACY(report))
            body = {k: report[k] for k in ("suite_sha256", "index_sha256", "inventory")}
            metrics = {k: v for k, v in report["metrics"].items() if "latency" not in k}
            records = [{k: v for k, v in r.items() if k != "retrieval_latency_ms"} for r in report["records"]]
            _need(report["semantic_sha256"] == canonical_sha256(body | {"metrics": metrics, "records": records}))
        else:
            _need(_REPORT(report))
            _sound_report(report)
    except (_Broken, OverflowError, TypeError, ValueError, KeyError):
        return False
    return True
