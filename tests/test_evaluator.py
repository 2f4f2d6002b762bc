import copy
import json

import pytest
from fixtures import digest, document, random_suite, suite
from oracle import rank

from evalloom.operators import corpus
from evalloom.plans import evaluator as ev
from evalloom.plans.sweep import SweepError
from evalloom.plans.verify import manifest_ok, report_ok
from evalloom.sources import artifacts
from evalloom.sources.contract import ContractError, Suite, canonical_sha256


@pytest.fixture(scope="module")
def evaluator(spark):
    return ev.Evaluator(spark, clock=iter(range(0, 10**15, 10**6)).__next__)


@pytest.fixture(scope="module")
def report(evaluator):
    return evaluator.run(Suite.from_dict(suite(retrieval_strategy="bm25")))


def test_report(report):
    assert report_ok(report) and report["metrics"]["pass_rate"] == 1.0
    town = report["records"][0]
    assert [h["chunk_id"] for h in town["retrieved"]] == ["guide:0:0-12", "guide:1:10-17"] and town["precision_at_k"] == 0.5
    assert report["records"][1]["precision_at_k"] == 0.0 and report["metrics"]["mean_retrieval_latency_ms"] == 0.5


def mutated(**changes):
    data = suite()
    for path, value in changes.items():
        where, *keys = path.split("__")
        target = data if where == "suite" else data[where][0]
        for key in keys[:-1]:
            target = target[int(key) if key.isdigit() else key]
        target[keys[-1]] = value
    return Suite.from_dict(data)


@pytest.mark.parametrize(("change", "errors", "failures"), [
    ({"documents__content": "Something else entirely."}, ["hash_mismatch"], ["retrieval_miss", "invalid_citation", "ungrounded_claim"]),
    ({"documents__trust": "untrusted"}, ["trust_untrusted"], ["retrieval_miss", "invalid_citation", "ungrounded_claim"]),
    ({"documents__expires_at": "2026-05-31"}, ["expired"], ["retrieval_miss", "invalid_citation", "ungrounded_claim"]),
    ({"documents__observed_at": "2026-06-02"}, ["observed_in_future"], ["retrieval_miss", "invalid_citation", "ungrounded_claim"]),
    ({"questions__response__claims__0__citations": ["missing"]}, [], ["invalid_citation", "ungrounded_claim"]),
    ({"questions__response__claims__0__text": "Penguins paint purple pianos"}, [], ["ungrounded_claim"]),
    ({"questions__response": {"answer": None, "claims": []}}, [], ["no_answer_mismatch", "ungrounded_claim"]),
    ({"questions__text": "Zebras?"}, [], ["retrieval_miss", "invalid_citation"]),
    ({"documents__expires_at": "2026-06-01"}, [], []),
])
def test_one_changed_field(evaluator, change, errors, failures):
    report = evaluator.run(mutated(**change))
    assert report_ok(report)
    assert report["inventory"]["documents"][0]["errors"] == errors and report["records"][0]["failures"] == failures


@pytest.mark.parametrize("strategy", ["overlap", "bm25", "tfidf", "hybrid"])
def test_against_plain_python(evaluator, strategy):
    data = random_suite(hash(strategy) % 7)
    report = evaluator.run(Suite.from_dict(data | {"retrieval_strategy": strategy, "hybrid_weight": 0.3}))
    assert report_ok(report)
    want = rank(data, strategy, 0.3)
    got = {r["question_id"]: [(h["chunk_id"], h["score"]) for h in r["retrieved"]] for r in report["records"]}
    assert {q: [c for c, _ in hits] for q, hits in got.items()} == {q: [c for c, _ in hits] for q, hits in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_partitioning_changes_nothing(spark, evaluator, report):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        again = evaluator.run(Suite.from_dict(suite(retrieval_strategy="bm25")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert again["semantic_sha256"] == report["semantic_sha256"]


def test_inventory_and_duplicates(evaluator):
    content = suite()["documents"][0]["content"]
    found = evaluator.inventory(Suite.from_dict(suite(documents=[document("guide", content), document("copy", content, trust="blocked")])))
    assert found["duplicates"] == [["copy", "guide"]] and found["fresh_coverage"] == 0.5 and found["documents"][1]["errors"] == ["trust_blocked"]


def test_no_valid_documents_and_chunk_limit(evaluator):
    none = evaluator.index_manifest(mutated(documents__trust="blocked"))
    assert none["chunk_count"] == 0 and manifest_ok(none)
    wide = "w " * 66_666
    with pytest.raises(ContractError, match="100000"):
        evaluator.index_manifest(Suite.from_dict(suite(chunk_size=8, chunk_overlap=7, documents=[document("guide", wide), document("more", wide)])))


def test_manifest(evaluator, tmp_path):
    own = Suite.from_dict(suite())
    manifest = evaluator.index_manifest(own)
    assert evaluator.verify_index_manifest(own, manifest) and manifest["chunks"][0]["text_sha256"] == digest("The northern lighthouse was built in the town of Lindholm by forty")
    artifacts.write_manifest(tmp_path / "m.json", manifest)
    assert artifacts.load_manifest(tmp_path / "m.json") == manifest
    forged = copy.deepcopy(manifest)
    forged["chunks"][0]["token_count"] -= 1
    assert not manifest_ok(forged)
    forged["manifest_sha256"] = canonical_sha256({k: v for k, v in forged.items() if k != "manifest_sha256"})
    assert manifest_ok(forged) and not evaluator.verify_index_manifest(own, forged)


@pytest.mark.parametrize("tamper", [
    lambda r: r["metrics"].update(pass_rate=0.25), lambda r: r["metrics"]["pass_rate_ci95"].update(lower=0.5), lambda r: r["records"][0].update(passed=False), lambda r: r["records"][0]["retrieved"][0].update(text="other"),
    lambda r: r["records"][0]["retrieved"].reverse(), lambda r: r["records"][0]["retrieved"][0].update(score=0.0), lambda r: r["records"][0].update(expected_source_ids=["nowhere"]), lambda r: r["records"].append(r["records"][0]),
    lambda r: r["inventory"].update(valid_document_count=0), lambda r: r["inventory"]["documents"][0].update(errors=["expired"]), lambda r: r["records"][0]["claims"][0].update(supported=False), lambda r: r.update(extra=1), lambda r: r["metrics"].update(retrieval_strategy="tfidf"),
])
def test_rehashed_forgeries(report, tamper):
    forged = copy.deepcopy(report)
    tamper(forged)
    forged["semantic_sha256"] = ev.semantic_sha256({k: v for k, v in forged.items()})
    assert not report_ok(forged)


def test_other_values_are_no_reports(report):
    for value in (None, [], {}, {"schema_version": "1.0"}, report | {"semantic_sha256": "0" * 64}, report | {"metrics": None}):
        assert not report_ok(value)
    slower = copy.deepcopy(report)
    for r in slower["records"]:
        r["retrieval_latency_ms"] += 5
    slower["metrics"]["mean_retrieval_latency_ms"] += 5
    assert report_ok(slower)


def test_legacy_reports(report):
    old = {k: report[k] for k in ("suite_id", "suite_version", "suite_sha256", "index_sha256", "inventory", "metrics", "records")} | {"schema_version": "1.0"}
    strip = lambda d: {k: v for k, v in d.items() if "latency" not in k}
    old["semantic_sha256"] = canonical_sha256({k: old[k] for k in ("suite_sha256", "index_sha256", "inventory")} | {"metrics": strip(old["metrics"]), "records": [strip(r) for r in old["records"]]})
    assert report_ok(old) and not report_ok(old | {"suite_id": "X"}) and not report_ok(old | {"metrics": {}})


def test_artifacts(report, tmp_path):
    path = tmp_path / "deep" / "r.json"
    artifacts.write_report(path, report)
    before = path.read_bytes()
    with pytest.raises(ContractError):
        artifacts.write_report(path, report | {"suite_id": "other"})
    with pytest.raises(ContractError):
        artifacts.write_report(tmp_path, report)
    assert path.read_bytes() == before and json.loads(before) == report and [p.name for p in path.parent.iterdir()] == ["r.json"]
    artifacts.export_report(tmp_path / "r.md", report, "markdown")
    artifacts.export_report(tmp_path / "r.html", report, "html")
    assert "| Pass rate | 100.0% |" in (tmp_path / "r.md").read_text() and "<td>town</td>" in (tmp_path / "r.html").read_text()
    with pytest.raises(ContractError):
        artifacts.export_report(tmp_path / "x", report, "pdf")
    with pytest.raises(ContractError):
        artifacts.render_html(report | {"suite_id": "other"})


def test_comparison(evaluator, report):
    other = evaluator.run(Suite.from_dict(suite(retrieval_strategy="overlap")))
    assert ev.compare_reports(report, report)["changed_questions"] == []
    found = ev.compare_reports(report, other | {"records": other["records"][:1]})
    assert [c["question_id"] for c in found["changed_questions"]] == ["owner", "town"] and found["changed_questions"][0]["candidate_passed"] is None and found["metric_deltas"]["pass_rate"] == 0


def test_sweep(evaluator, tmp_path):
    own = Suite.from_dict(suite())
    a = evaluator.sweep(own, ["overlap", "bm25"], [12], [2, 20])
    assert len(a["runs"]) == 2 and a["best_run_id"] in {r["run_id"] for r in a["runs"]} and all(r["quality_score"] == 1.0 for r in a["runs"])
    assert evaluator.sweep(own, ["bm25", "overlap"], [12], [20, 2])["semantic_sha256"] == a["semantic_sha256"]
    artifacts.write_sweep(tmp_path / "s.json", a)
    for bad in ((["magic"], [12], [2]), (["bm25"], [4], [2]), (["bm25"], [12], [12]), (["bm25", "bm25"], [12], [2]), ([], [12], [2]), (["bm25"], list(range(20, 60)), [0])):
        with pytest.raises(SweepError):
            evaluator.sweep(own, *bad)


def test_chunk_windows(spark):
    rows = [("s", f"d{n}", "w " * n, "h", size, overlap) for n in (0, 1, 7, 8, 9, 20, 61) for size, overlap in ((8, 0), (8, 7), (20, 5))]
    df = spark.createDataFrame([(a, f"{b}-{e}-{f}", c, d, e, f) for a, b, c, d, e, f in rows], "suite_id string, source_id string, content string, sha256 string, chunk_size int, chunk_overlap int")
    counts = {r.source_id: r.n_chunks for r in corpus.chunk_counts(df).collect()}
    made = corpus.chunk(df).groupBy("source_id").count().collect()
    assert {k: v for k, v in counts.items() if v} == {r.source_id: r["count"] for r in made}
