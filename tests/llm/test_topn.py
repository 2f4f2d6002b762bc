import random
from datetime import datetime, timedelta

from evalloom.llm.topn import LoserTree, latest_scores, top_n

SCHEMA = "question_id string, chunk_id string, score double, logged_at timestamp, g string, s double, run int"


def brute(rows, n):
    latest = {}
    for q, c, s, t, *_ in rows:
        if q is None or c is None or s is None or s != s:
            continue
        key = (t is not None, t or datetime(1, 1, 1), s)
        if (q, c) not in latest or key > latest[q, c]:
            latest[q, c] = key
    out = set()
    for q in {q for q, _ in latest}:
        ranked = sorted(((-k[2], c.encode(), c) for (p, c), k in latest.items() if p == q))[:n]
        out |= {(q, c, -s, i + 1) for i, (s, _, c) in enumerate(ranked)}
    return out


def run(spark, rows, n=5, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {(r.g, r.i, r.s, r.place) for r in top_n(latest_scores(df, "question_id", "chunk_id", "score", "logged_at"), n).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    start = datetime(2026, 1, 1)
    rows = []
    for _ in range(4000):
        q = "hot" if rng.random() < 0.4 else f"q{rng.randrange(150)}"
        score = rng.choice([None, float("nan"), *([round(rng.random(), 1)] * 8)])
        rows.append((q, rng.choice(["é", "z", "A", "a", "😀", "ﬀ"]) + str(rng.randrange(60)), score, rng.choice([None, start + timedelta(seconds=rng.randrange(50))]), "x", 1.0, 2))
    rows += rows[:500]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, rows, n=1, parts=1) == brute(rows, 1)


def test_edge_cases(spark):
    assert run(spark, []) == set()
    t = datetime(2026, 1, 1)
    rows = [("q", "a", float("inf"), t, "", 0.0, 0), ("q", "b", float("-inf"), t, "", 0.0, 0), ("q", "c", 0.0, t, "", 0.0, 0), ("q", "d", -0.0, t, "", 0.0, 0), (None, "a", 1.0, t, "", 0.0, 0), ("q", None, 1.0, t, "", 0.0, 0)]
    assert [c for _, c, _, _ in sorted(run(spark, rows), key=lambda r: r[3])] == ["a", "c", "d", "b"]


def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        tree, out = LoserTree(runs), []
        while (x := tree.pop()) is not None:
            out.append(x)
        assert out == sorted(x for r in runs for x in r)
