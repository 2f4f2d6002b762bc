import random

from evalloom.llm.leakage import find_leaks, myers_distance, split_pieces


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(4)
    for _ in range(300):
        pattern = [rng.choice("abc") for _ in range(rng.randrange(1, 90))]
        text = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
        assert myers_distance(pattern, text) == plain_distance(pattern, text)


def test_pieces():
    for n in range(1, 60):
        pieces = split_pieces(n, 6)
        assert pieces[0][0] == 0 and pieces[-1][1] == n and all(1 <= b - a <= 6 for a, b in pieces)
        assert all(x[1] == y[0] for x, y in zip(pieces, pieces[1:], strict=False))


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, text string, norm string, item int")
    e = spark.createDataFrame([(i, t, "y") for i, t in enumerate(items)], "item_id long, text string, doc string")
    found, many = ({(r.doc_id, r.item_id): (r.longest_run, r.edit_distance) for r in find_leaks(d, "doc_id", "text", e, "item_id", "text", max_chars=n).collect()} for n in (1 << 20, 0))
    assert found == many
    return found


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(27, 50))] for _ in range(20)]
    docs = []
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)
            a = rng.randrange(len(item) - 8)
            part = item[a : a + rng.randrange(8, 30)]
            if rng.random() < 0.4 and len(part) > 14:
                part[rng.randrange(len(part))] = "changed"
            k = rng.randrange(len(words) + 1)
            words[k:k] = part
        docs.append(words)
    got = run(spark, [" ".join(d).upper().replace(" ", ", ") for d in docs], [" ".join(i) for i in items])
    want = {(d, i): n for d, x in enumerate(docs) for i, y in enumerate(items) if (n := longest(x, y)) >= 12}
    assert {k: v[0] for k, v in got.items() if v[0] >= 12} == want and len(want) > 30


def test_edits_within_the_budget(spark):
    item = [f"k{i}" for i in range(30)]
    changed = list(item)
    for k in (5, 12, 18, 25):
        changed[k] = "other"
    got = run(spark, [" ".join(changed), " ".join(item[::-1])], [" ".join(item)])
    assert got == {(0, 0): (6, 4)}


def test_edge_cases(spark):
    item = " ".join(f"k{i}" for i in range(12))
    assert run(spark, [], [item]) == {} and run(spark, [item], []) == {}
    got = run(spark, [None, "", "—", item, "pad " * 300_000 + item], [item, None, "", item.upper(), "k0 k1"])
    assert {k for k in got if k[1] in (0, 3)} == {(3, 0), (3, 3), (4, 0), (4, 3)} and got[3, 0] == (12, 0) and (3, 4) in got
