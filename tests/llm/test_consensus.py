import random

from evalloom.llm import consensus
from evalloom.llm.consensus import agree, consensus_values, distance, merge, preferred_values, tokenize, vote

SCHEMA = "first_id long, record_id long, title string, url string, w double, value string, lane int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {(r.first_id, r.field_name): (r.value, r.from_record_id, r.edits) for r in consensus_values(df, "first_id", "record_id", "w", ("title", "url")).collect()}


def test_votes_are_by_column():
    profile = []
    for value in ("the old harbour guide", "the harbour guide", "the new harbour guide copy"):
        profile = merge(profile, [{t: 1.0} for t in tokenize(value)])
    assert vote(profile, 3.0) == ["the", "harbour", "guide"] and distance("a b c".split(), "a c d".split()) == 2


def test_weights_ties_and_gaps(spark):
    rows = [
        (1, 1, "Harbour guide (copy)", None, 1.0), (1, 2, "Harbour guide", "u/2", 1.0), (1, 3, "Harbour guide", " ", 1.0), (1, 3, "Harbour guide", " ", 1.0), (1, 4, "Harbor guide", "u/4", 5.0),
        (2, 6, "b", None, 1.0), (2, 5, "a", None, 1.0), (3, 7, None, "", 1.0), (4, 8, "x", "y", None),
    ]
    got = run(spark, rows)
    assert got[1, "title"] == ("Harbor guide", 4, 0) and got[1, "url"] == ("u/4", 4, 0)
    assert got[2, "title"][0] in "ab" and (3, "title") not in got and (3, "url") not in got and got[4, "title"][:2] == ("x", 8)
    assert run(spark, []) == {}


def test_many_values_in_lanes(spark, monkeypatch):
    monkeypatch.setattr(consensus, "ALIGNED_TOGETHER", 8)
    rows = [(1, i, f"Harbour guide number {i} of the town", None, 1.0) for i in range(60)] + [(1, 99, "Harbour guide of the town", None, 0.5)]
    # The consensus has the word but no number: one token from each of the sixty and from the last, which weighs less.
    assert run(spark, rows)[1, "title"] == ("Harbour guide number 0 of the town", 0, 1)


def test_late_votes_change_nothing():
    rng = random.Random(2)
    for _ in range(200):
        values = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(5)]
        weights = sorted((rng.choice([1, 2, 4, 30]) for _ in values), reverse=True)
        members = [([{t: w} for t in tokenize(v)], w) for v, w in zip(values, weights, strict=True)]
        assert vote(*agree(members, True)) == vote(*agree(members, False))


def test_an_order_of_preference_in_lanes(spark, monkeypatch):
    monkeypatch.setattr(consensus, "ALIGNED_TOGETHER", 4)
    rng = random.Random(3)
    rows = [(s, "license", f"Licence {rng.randrange(40)} of {rng.choice('ab')}", rng.randrange(4), rng.randrange(-9, 2), i) for i, s in enumerate(rng.choice([1, 1, 1, 2, 3]) for _ in range(300))]
    df = spark.createDataFrame(rows, "s long, field_name string, value string, rank int, age int, id long")
    want = {s: min((r[3:], r[2]) for r in rows if r[0] == s) for s in (1, 2, 3)}
    assert {r.s: (r.value, r.from_record_id) for r in preferred_values(df, "s").collect()} == {s: (v, at[2]) for s, (at, v) in want.items()}
