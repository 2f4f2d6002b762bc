import json

import pytest
from fixtures import document, suite

from evalloom.sources.contract import MAX_SUITE_BYTES, ContractError, Suite, canonical_json, canonical_sha256, read_bounded, strict_json


def broken(change):
    data = suite()
    change(data)
    with pytest.raises(ContractError):
        Suite.from_dict(data)


@pytest.mark.parametrize("change", [
    lambda s: s.update(extra=1), lambda s: s.pop("version"), lambda s: s.update(version="1.0"), lambda s: s.update(schema_version="2.0"), lambda s: s.update(suite_id="Upper"), lambda s: s.update(suite_id="a\n"), lambda s: s.update(evaluation_date="2026-9-1"),
    lambda s: s.update(chunk_size=True), lambda s: s.update(chunk_size=7), lambda s: s.update(chunk_overlap=12), lambda s: s.update(retrieval_k=21), lambda s: s.update(retrieval_strategy="magic"), lambda s: s.update(hybrid_weight=10**400), lambda s: s.update(hybrid_weight=True),
    lambda s: s.update(documents=[]), lambda s: s.update(documents=s["documents"] * 2), lambda s: s["documents"][0].update(trust="odd"), lambda s: s["documents"][0].update(content=" "), lambda s: s["documents"][0].update(sha256="A" * 64), lambda s: s["documents"][0].update(title="x" * 201),
    lambda s: s["documents"][0].update(observed_at=None), lambda s: s.update(documents=[document(f"d{i}", "x") for i in range(201)]), lambda s: s["questions"][0].update(no_answer=True), lambda s: s["questions"][0].update(no_answer=0), lambda s: s["questions"][0].update(expected_source_ids=["guide", "guide"]),
    lambda s: s["questions"][0].update(expected_source_ids=["nowhere"]), lambda s: s["questions"][0]["response"].update(answer=None), lambda s: s["questions"][0]["response"]["claims"][0].update(citations=[]), lambda s: s["questions"][1].update(question_id="town"), lambda s: s.update(questions={}),
])
def test_one_broken_field(change):
    broken(change)


def test_strict_json():
    with pytest.raises(ContractError, match="duplicate"):
        strict_json('{"a": 1, "a": 2}')
    for text in ("{", "[" * 100_000):
        with pytest.raises(ContractError):
            strict_json(text)
    with pytest.raises(ContractError):
        Suite.from_json(b"{}")
    with pytest.raises(ContractError, match="exceeds"):
        Suite.from_json(" " * (MAX_SUITE_BYTES + 1))


def test_reading(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(suite()))
    assert Suite.load(path).suite_id == "unit"
    path.write_bytes(b"\xff")
    for bad in (path, tmp_path / "none.json", tmp_path):
        with pytest.raises(ContractError):
            read_bounded(bad, 100, "suite")


def test_digest():
    plain = Suite.from_dict(suite())
    assert canonical_json({"b": 1e-5, "a": "é"}) == '{"a":"\\u00e9","b":1e-05}'
    assert plain.digest == Suite.from_dict(suite(retrieval_strategy="overlap", hybrid_weight=0.5)).digest == canonical_sha256(plain.to_dict())
    assert "hybrid_weight" not in plain.to_dict() and plain.to_dict()["questions"][0]["adversarial"] is False
    weighted = Suite.from_dict(suite(hybrid_weight=1))
    assert weighted.to_dict()["hybrid_weight"] == 1.0 and weighted.to_dict()["retrieval_strategy"] == "overlap" and weighted.digest != plain.digest
    assert Suite.from_dict(suite(evaluation_date="20260601")).digest == plain.digest
