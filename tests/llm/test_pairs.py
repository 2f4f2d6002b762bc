import random

import pytest

from evalloom.llm.pairs import find_defective_pairs, is_echo, is_empty, one_defect, open_structures, script, stops_short, tiles, unquoted

SCHEMA = "question_id string, text string, no_answer boolean, response struct<answer: string, claims: array<struct<text: string, citations: array<string>>>>, pid string, question string"
TOWNS = [f"Town{chr(97 + i)}{chr(97 + j)}ia" for i in range(12) for j in range(5)]


@pytest.mark.parametrize("text", [None, "", "  \xa0", "…", "--", "<br/>", "&nbsp;", "[answer]", "N/A", "(blank)", "TBD.", '""', "undefined"])
def test_empty(text):
    assert is_empty(text)


@pytest.mark.parametrize("text", ["0", "No", "None of them", "é", "An answer", "日本"])
def test_not_empty(text):
    assert not is_empty(text)


def test_pushdown_parser():
    assert open_structures('He said "no') == ['"'] and open_structures("```py\nx = [1") == ["```"]
    assert open_structures("f(a[0]") == ["("] and open_structures("<b>bold") == ["b"] and open_structures("a <im") == ["<"]
    for fine in ('He said "no" (twice).', "```x[```", "1) one 2) two", "<b>x</b><br>", "a 5\" disk", "it's l'eau :)", "„so“ «là»", "a < b", ""):
        assert open_structures(fine) == []


def test_tiling_and_echo():
    assert tiles("a b c x d e".split(), "d e a b c".split()) == 5 and tiles([], ["a"]) == 0
    q = "where is the town hall".split()
    assert is_echo(q, q) and is_echo(q, q * 3) and is_echo(q, [*q, *q])
    assert not is_echo(q, [*q, "in", "the", "old", "market"]) and not is_echo(q, ["the", "town", "hall"]) and not is_echo([], q)
    long = [f"w{i}" for i in range(20_000)]
    assert is_echo(long, long) and is_echo(long, long[10:] + long[:10]) and not is_echo(long, long[::-1])


def test_form_of_the_end():
    assert stops_short("It is held in Lin,", []) and stops_short("It was moved bec…", []) and stops_short("A sign reads \"No ent", []) and stops_short("Steps:\n1.", [])
    assert stops_short("It is held in Lind", ["The fair is held in Lindholm"])
    assert stops_short("Yes!", []) is False and stops_short("In Lindholm", ["It is held in Lindholm"]) is None


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r.question_id: r.defect for r in one_defect(find_defective_pairs(df)).collect()}


def test_defects(spark):
    rows = []
    for i, town in enumerate(TOWNS):
        rows.append((f"en{i}", f"Where is the fair of {town} held?", False, (f"The fair of {town} is held in the market hall of {town}." if i % 2 else "In the market hall", [(f"The fair of {town} is held in the market hall", ["s"])])))
        rows.append((f"de{i}", f"Wo findet die Messe von {town} statt?", False, (f"Die Messe von {town} findet in der alten Halle statt", [("Sie findet in der alten Halle statt", ["s"])])))
    bad = [
        ("b1", "Where is the fair held?", False, (None, []), "empty"),
        ("b2", "Where is the fair held?", False, None, "empty"),
        ("b3", "Where is the fair held?", False, ("In the market hall", [("", ["s"])]), "empty"),
        ("b4", "Where is the fair held?", False, ("I'm sorry, but I can't help with that.", []), "refusal"),
        ("b5", "Wo findet die Messe statt?", False, ("Dazu kann ich leider keine Auskunft geben", []), "refusal"),
        ("b6", "Where is the fair of Towna held?", False, ("where is the fair of towna held", []), "echo"),
        ("b7", "Where is the fair of Townabia held?", False, ("Die Messe findet in der alten Halle statt", []), "language"),
        ("b8", "Where is the fair held?", False, ("The fair is held in the mark", []), "truncated"),
        ("b9", "Where is the fair held?", False, ("The fair is held in the", []), "truncated"),
        ("ba", "Where is the fair held?", False, ("它在市场举行", []), "language"),
    ]
    good = [
        ("g1", "Who founded it?", True, (None, [])),
        ("g2", "Where is the fair held?", None, ('The fair is held in the market hall. A sign there reads "Bitte nicht stören".', None)),
        ("g3", "Where is the fair held?", False, ("Where is the fair held?\nIn the market hall", [])),
        ("g4", None, False, ("In the market hall", [])),
        ("g5", "Where is the fair held?", False, ("Visitors cannot take photographs and the hall will not refund tickets.", [])),
    ]
    got = run(spark, rows + [b[:4] for b in bad] + good + rows[:10])
    assert got == {b[0]: b[4] for b in bad}


def test_edge_cases(spark):
    assert run(spark, []) == {}
    long = "The market hall is open. " * 40_000
    assert run(spark, [("q", "Where is it?", False, (long, [])), ("r", "x " * 50_000, False, ("x " * 50_000, [])), (None, None, None, None)]) == {"r": "echo", None: "empty"}


def _plain_tiles(a, b):
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best, at = 1, None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best:
                    best, at = k, (i, j)
        if not at:
            return covered
        free_a[at[0] : at[0] + best] = free_b[at[1] : at[1] + best] = [False] * best
        covered += best


def test_one_tiling_for_all_lengths():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("uvwxyz"[: rng.randrange(1, 7)]) for _ in range(rng.randrange(25))] for _ in range(2))
        assert tiles(a, b) == _plain_tiles(a, b)
    for n in (480, 600, 6000):
        words = [f"w{i}" for i in range(n)]
        phrases = [words[i : i + 3] for i in range(0, n, 3)]
        rng.shuffle(phrases)
        assert is_echo(words, sum(phrases, []))
    assert tiles(["x"] * 30_000, ["x", "x", "y"] * 10_000) == 20_000


def test_long_tags_and_quotations():
    link = f'<a href="https://a.invalid/{"x" * 400}" title="x > y">the hall</a>'
    assert open_structures(f"See {link.replace(' > ', ' ')}.") == [] and stops_short(f"See {link}.", []) is False and not stops_short(f"See {link}!", [])
    assert not is_empty("<No answer is given in any of the documents listed>") and is_empty(f'<img src="{"x" * 400}"/>')
    for a, b in ('""', "“”", "„“", "«»"):
        assert unquoted(f"He said {a}{'I cannot say. ' * 40}{b} once") == "He said   once"
    assert unquoted('5" disk\n6" disk “') == '5" disk\n6" disk “' and len(unquoted("“" * 300_000)) == 300_000


def test_script_of_the_whole_text():
    assert script("code " * 6_000 + "它在市场举行" * 10_000) == "cjk" and script("它 a") == "cjk" and script("1 2") is None


def test_lists_are_parsed():
    for cut in ("Steps:\n- one\n-", "Steps:\n1. one\n  -", "Steps:\n- [x] one\n- [ ]", "-\n  -", "1)"):
        assert open_structures(cut) == ["-"] and stops_short(cut, [])
    for fine in ("- one\n- two", "-\n- two", "1.\n   text", "a -", "```\n-\n```", "- one\n\nAll of it", "It is - well\n2.5"):
        assert open_structures(fine) == []
