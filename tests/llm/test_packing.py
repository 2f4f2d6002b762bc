import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm.packing import dominance_reduction, pack_texts, plan_containers


def exact(sizes, capacity):
    """Fewest containers, by search."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, [r - sizes[k] if j == i else r for j, r in enumerate(rooms)])
        place(k + 1, [*rooms, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def histogram(sizes, capacity):
    return np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, np.int64)


@given(st.lists(st.integers(1, 12), max_size=9))
@settings(max_examples=120, deadline=None)
def test_reduction_loses_no_optimum(sizes):
    fixed, rest = dominance_reduction(histogram(sizes, 12))
    left = [s for s, n in enumerate(rest) for _ in range(n)]
    assert sum(n for _, n in fixed) + exact(left, 12) == exact(sizes, 12)


@given(st.lists(st.integers(1, 64), max_size=300))
@settings(max_examples=80, deadline=None)
def test_patterns_hold_every_item(sizes):
    counts = histogram(sizes, 64)
    back = np.zeros(65, np.int64)
    patterns = plan_containers(counts)
    for pattern, n in patterns:
        assert n > 0 and 0 < sum(s * k for s, k in pattern) <= 64
        for s, k in pattern:
            back[s] += k * n
    assert (back == counts).all()
    assert sum(n for _, n in patterns) <= max(1, -(-int((counts * np.arange(65)).sum()) // 64)) * 11 / 9 + 1


def run(spark, texts, capacity=16):
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, size int, piece string")
    return pack_texts(df, "doc_id", "text", capacity).collect()


def test_containers(spark):
    rng = random.Random(3)
    texts = ["ab " * (rng.randrange(60) if i % 3 else 7) for i in range(600)] + [None, "", "a b c", "é ü"]
    rows = run(spark, texts)
    room, tokens = defaultdict(int), defaultdict(int)
    for r in rows:
        room[r.container] += r.n_tokens
        tokens[r.doc_id] += r.n_tokens
        assert (r.n_pieces > 1) == (len((texts[r.doc_id] or "").split()) > 16 and "ab" in texts[r.doc_id])
    assert max(room.values()) <= 16 and set(room) == set(range(len(room)))
    assert all(tokens[i] == (t or "").count("ab") for i, t in enumerate(texts))
    assert len(room) <= 1.03 * -(-sum(room.values()) // 16)
    assert sorted((r.doc_id, r.piece) for r in rows) == sorted(set((r.doc_id, r.piece) for r in rows))


def test_edge_cases(spark):
    assert run(spark, []) == []
    assert {r.container for r in run(spark, [None, ""])} == {0}
    assert [r.n_pieces for r in run(spark, ["ab " * 100_000])][0] == 6250
