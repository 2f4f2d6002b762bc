import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm.splitting import RangeMaximum, cut_points, split_oversized

SCHEMA = "kind string, key string, text string, size int, overlap int, ordinal string"


@given(st.lists(st.integers(0, 4), min_size=1, max_size=200), st.integers(1, 40), st.integers(0, 50))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_and_overlap(strengths, size, overlap):
    values = np.array(strengths, np.int8)
    pieces = cut_points(values, size, overlap)
    back = min(overlap, size - 1)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(values)
    assert all(0 < b - a <= size for a, b in pieces)
    assert all(nxt[0] == prev[1] - back and nxt[1] > prev[1] for prev, nxt in zip(pieces, pieces[1:], strict=False))


@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.data())
@settings(max_examples=100, deadline=None)
def test_range_maximum(values, data):
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    best = max(range(low, high + 1), key=lambda i: (values[i], i))
    assert RangeMaximum(np.array(values)).argmax(low, high) == best


def run(spark, rows):
    return split_oversized(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).orderBy("key", "ordinal").collect()


def test_natural_boundaries(spark):
    text = "One two three four. Five six seven eight nine ten.\n\nEleven twelve thirteen fourteen e.g. fifteen sixteen seventeen."
    got = [r.text for r in run(spark, [("record", "a", text, 8, 2)])]
    assert got[0].endswith("four.") and any(t.endswith("ten.") for t in got) and " ".join(got[-1].split()[-2:]) == "sixteen seventeen."


def test_edge_cases(spark):
    nbsp = "a b c d"
    rows = [("r", "null", None, 3, 1), ("r", "empty", "", 3, 1), ("r", "fits", "a b c", 3, 1), ("r", "nbsp", nbsp, 3, 9), ("r", "nbsp", nbsp, 3, 9), ("r", "free", "a b c d e", None, 1), ("r", "zero", "a b", 0, 0), ("r", "word", "x" * 1_000_000, 1, 0), ("r", "gap", "a b c", 2, None), ("r", "long", "w. " * 100_000, 400, 16)]
    got = run(spark, rows)
    assert {r.key for r in got} == {"nbsp", "gap", "long"}
    assert [(r.ordinal, r.text) for r in got if r.key == "nbsp"] == [(0, "a b c"), (1, "b c d")]
    assert all(r.n_words <= 400 for r in got) and run(spark, []) == []
