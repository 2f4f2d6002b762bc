"""A plain Python evaluation of a suite, to hold the Spark path against."""

import hashlib
import math
import re
from collections import Counter


def tokens(text):
    return [t.lower() for t in re.findall(r"[a-z0-9]+", text, re.IGNORECASE) if len(t) > 1]


def windows(document, size, overlap):
    words, out, start = document["content"].split(), [], 0
    while words and (not out or out[-1][2] < len(words)):
        end = min(start + size, len(words))
        out.append((f"{document['source_id']}:{len(out)}:{start}-{end}", document["source_id"], end, " ".join(words[start:end])))
        start += size - overlap
    return [(i, s, t) for i, s, _, t in out]


def cosine(a, b):
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    size = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return dot / size if size else 0.0


def hashed(counts, idf):
    out = Counter()
    for t, n in counts.items():
        d = hashlib.sha256(t.encode()).digest()
        out[int.from_bytes(d[:4], "big") % 128] += (1 if d[4] % 2 else -1) * n * idf.get(t, 1.0)
    return out


def rank(suite, strategy, weight=0.5):
    """question id -> [(chunk id, score)], best first."""
    day = suite["evaluation_date"]
    valid = [d for d in suite["documents"] if d["trust"] == "trusted" and d["sha256"] == hashlib.sha256(d["content"].encode()).hexdigest() and d["observed_at"] <= day and (d["expires_at"] or "9999") >= day]
    chunks = [(i, Counter(tokens(t))) for d in valid for i, _, t in windows(d, suite["chunk_size"], suite["chunk_overlap"])]
    df = Counter(t for _, c in chunks for t in c)
    n = len(chunks)
    average = sum(sum(c.values()) for _, c in chunks) / n if n else 0
    bm = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    ti = {t: math.log((n + 1) / (f + 1)) + 1 for t, f in df.items()}

    def bm25(q, c):
        return sum(bm[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / average)) for t in q if c[t])

    def score(q, c):
        if strategy == "overlap":
            return len(q.keys() & c.keys()) / len(q) if q else 0.0
        if strategy == "bm25":
            return bm25(q, c)
        if strategy == "tfidf":
            return cosine({t: k * ti.get(t, 0) for t, k in q.items()}, {t: k * ti[t] for t, k in c.items()})
        lexical = bm25(q, c)
        return weight * lexical / (1 + lexical) + (1 - weight) * max(0.0, cosine(hashed(q, ti), hashed(c, ti)))

    out = {}
    for question in suite["questions"]:
        q = Counter(tokens(question["text"]))
        scored = sorted(((-round(score(q, c), 9), i) for i, c in chunks))[: suite["retrieval_k"]]
        out[question["question_id"]] = [(i, round(-s, 6)) for s, i in scored if s < 0]
    return out
