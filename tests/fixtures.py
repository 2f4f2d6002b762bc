import copy
import hashlib
import random


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def document(source_id, content, **changes):
    return {"source_id": source_id, "title": source_id, "source_url": f"https://example.invalid/{source_id}", "license": "CC0-1.0", "observed_at": "2026-01-10", "expires_at": "2027-01-10", "trust": "trusted", "content": content, "sha256": digest(content)} | changes


def suite(**changes):
    content = "The northern lighthouse was built in the town of Lindholm by forty masons and opened in May."
    out = {
        "schema_version": "1.0", "suite_id": "unit", "version": "1.0.0", "evaluation_date": "2026-06-01", "chunk_size": 12, "chunk_overlap": 2, "retrieval_k": 3, "documents": [document("guide", content)],
        "questions": [
            {"question_id": "town", "text": "In which town was the lighthouse built?", "expected_source_ids": ["guide"], "no_answer": False, "response": {"answer": "Lindholm", "claims": [{"text": "The lighthouse was built in Lindholm", "citations": ["guide"]}]}},
            {"question_id": "owner", "text": "Who owns the northern lighthouse?", "expected_source_ids": [], "no_answer": True, "adversarial": True, "response": {"answer": None, "claims": []}},
        ],
    }
    return copy.deepcopy(out | changes)


def random_suite(seed):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(60)] + ["a", "I", "9", "É", "naïve", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(n))
    documents = [document(f"d{i}", text(rng.randrange(1, 90)), **rng.choice([{}, {}, {}, {"trust": "blocked"}, {"sha256": "0" * 64}, {"expires_at": None}, {"expires_at": "2026-05-31"}, {"observed_at": "2026-06-02"}])) for i in range(12)]
    questions = []
    for i in range(10):
        expected = rng.sample([d["source_id"] for d in documents], rng.randrange(0, 3))
        claims = [{"text": text(rng.randrange(1, 8)), "citations": rng.sample([d["source_id"] for d in documents] + ["nowhere"], rng.randrange(1, 3))} for _ in range(rng.randrange(0, 3))]
        questions.append({"question_id": f"q{i}", "text": text(rng.randrange(1, 9)), "expected_source_ids": expected, "no_answer": not expected, "adversarial": rng.random() < 0.4, "response": {"answer": "yes" if claims else None, "claims": claims}})
    return suite(documents=documents, questions=questions, chunk_size=rng.randrange(8, 30), chunk_overlap=rng.randrange(0, 8))
