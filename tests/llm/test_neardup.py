import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from evalloom.llm.neardup import _WORD, CHUNKS, GUARANTEED, MAX_DISTANCE, SYMBOLS, _chunk_keys, connected_components, find_near_duplicates, may_be_close


def brute(texts):
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in texts.items() if t for w in [_WORD.findall(t.lower())]}
    canon = {k: "".join(_WORD.findall(t.lower())) for k, t in texts.items() if t}
    keys = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if canon[a] != canon[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        rng.choice([lambda: words.insert(k, rng.choice("abcdefgh") * 3), lambda: words.pop(k) if len(words) > 4 else None, lambda: words.__setitem__(k, "zz" + str(rng.random())[2:6])])()
    return words


def items(spark, texts, kind="chunk"):
    return spark.createDataFrame([(kind, k, t, False, "x", 1) for k, t in texts.items()], "kind string, key string, text string, fields boolean, rid string, n int")


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for base in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        for v in range(4):
            texts[f"{base:02}-{v}"] = " ".join(edited(words, rng, v * 3))
    found = find_near_duplicates(items(spark, texts))
    got = {(r.low_key, r.high_key) for r in found.pairs().collect()}
    want = brute(texts)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 100
    grouped = {r.key: r.group_id for r in found.groups().collect()}
    assert all(grouped[a] == grouped[b] for a, b in got) and len(grouped) == len(texts)


def test_edge_cases(spark):
    same = "one two three four five six seven eight nine ten eleven twelve"
    texts = {"a": same, "b": same.upper(), "c": same + " thirteen", "d": None, "e": "", "f": "one two", "g": "word " * 200_000, "h": "word " * 200_001}
    df = items(spark, texts)
    got = {(r.low_key, r.high_key) for r in find_near_duplicates(df.unionByName(df)).pairs().collect()}
    assert got == {("a", "c"), ("b", "c"), ("g", "h")}
    assert find_near_duplicates(df.where("false")).pairs().count() == 0
    assert find_near_duplicates(df.where("false")).groups().count() == 0


def test_kinds_and_fields_stay_apart(spark):
    card = ["alpha: one two three", "beta: four five six", "gamma: seven eight nine", "delta: ten eleven twelve"]
    texts = {"x": "\n".join(card), "y": "\n".join(card[::-1]), "z": "\n".join(card) + " thirteen"}
    records = items(spark, texts, "record").withColumn("fields", F.lit(True))
    got = {(r.kind, r.low_key, r.high_key) for r in find_near_duplicates(records.unionByName(items(spark, {"x": texts["z"]}))).pairs().collect()}
    assert ("record", "x", "y") not in got and ("record", "x", "z") in got and all(k == "record" for k, _, _ in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203)]
    got = {r.rid: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 203: 200, 205: 200}


def test_every_pair_within_the_guaranteed_distance_meets(spark):
    rng = random.Random(8)
    splits = [s for s in ((4, 3, 3, 3, 0, 0, 0, 0), (4, 4, 3, 3, 0, 0, 0, 0), (4, 4, 4, 3, 0, 0, 0, 0), (0, 0, 0, 0, 4, 4, 4, 3), (2, 2, 2, 2, 2, 2, 2, 1), (1,) * 8)]
    places = [[4 * c + k for c, n in enumerate(split) for k in rng.sample(range(4), n)] for split in splits] + [rng.sample(range(SYMBOLS), GUARANTEED) for _ in range(300)]
    base = np.random.default_rng(1).integers(0, 1 << 16, (len(places), SYMBOLS)).astype(np.uint16)
    other = base.copy()
    for row, at in zip(other, places, strict=True):
        row[at] ^= np.uint16(rng.randrange(1, 1 << 16))
    frame = lambda rows: pd.DataFrame({"rid": range(len(rows)), "kind": "chunk", "n_runs": 10, "sig": [r.tobytes() for r in rows]})
    left, right = (spark.createDataFrame(next(_chunk_keys(iter([frame(x)])))) for x in (base, other))
    met = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.rid") == F.col("r.rid")) & may_be_close(0.6))
    assert GUARANTEED == 2 * CHUNKS - 1 <= MAX_DISTANCE and met.select("l.rid").distinct().count() == len(places)
