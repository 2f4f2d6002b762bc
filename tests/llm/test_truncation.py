import pytest

from evalloom.llm.endings import ending_evidence
from evalloom.llm.truncation import closing, find_truncated, truncation_by_source

SCHEMA = "doc_id long, text string, source string, closing string, chars int, id string"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("All is well.", "stop"), ('He said "all is well."', "stop"), ("All is well. (see A-1)", "stop"), ("All is well.<br/>", "stop"), ("All is we…", "residue"), ("All is we ...", "residue"), ("All is we�", "residue"), ("All is we <br", "residue"), ("All is &nb", "residue"),
        ("All, ", "mark"), ("He said: \"", "mark"), ("x.\n\n- two pencils", "list"), ("x.\n1. one\n2. two", "list"), ("x. See https://a.invalid/b/", "address"), ("Write to a@b.org", "address"), ("x.\n\nNight porter, Lindholm", "signature"),
        ("Name: Lind\nFee: 3 marks\nHall: old", "field"), ("Name: Lind | Fee: 3 marks", "field"), ("Note: all is", "prose"), ("All is well and", "prose"), ("", "none"), ("…", "none"), ("  \n", "none"),
    ],
)
def test_closing(text, kind):
    assert closing(text) == kind


def run(spark, rows):
    df = spark.createDataFrame([(i, t, s, "x", 1, "y") for i, (t, s) in enumerate(rows)], SCHEMA)
    return {r.doc_id: r for r in find_truncated(df, "doc_id", "text", "source").collect()}


def test_limits_trie_and_closings(spark):
    full = "The old harbour archive keeps {} maps of the northern battery and a spare battery for the lamp.\n\n- loan slip\n- spare battery"
    rows = [(full.format(f"{n} hundred"), "free") for n in ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty")]
    cut = full.format("some")[:-2]
    padded = [("Word number %s is here. " % w * 9)[:90] for w in ("aa", "bb", "cc", "dd")]
    rows += [(cut, "free"), (cut, "free"), *((t, "limited") for t in padded), ("A complete text.", "limited"), ("x" * 89 + ".", "limited"), (None, None), ("", None), ("half a sent", None)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if r.cut} == {13, 14, *range(15, 19), 23}
    assert got[13].closing == "list" and got[13].longer and got[15].at_limit and got[20].at_limit and not got[20].cut and not got[19].at_limit
    df = spark.createDataFrame([(r.source, r.cut) for r in got.values()], "source string, cut boolean")
    shares = {r.source: (r.texts, r.cut_texts, r.share) for r in truncation_by_source(df, "source").collect()}
    assert shares == {"free": (15, 2, 0.133333), "limited": (6, 4, 0.666667), None: (3, 1, 0.333333)}


def test_edge_cases(spark):
    assert run(spark, []) == {}
    got = run(spark, [("word " * 300_000, "a"), ("w" * 1_000_000 + ".", "a")])
    assert got[0].cut and not got[1].cut


def test_prose_is_held_against_trie_and_corpus(spark):
    rows = [(f"Room {n} was painted. Room {n} is kept by the harbour board.", "a") for n in "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()]
    ends = ["Room forty is kept by the harbour board", "Room forty is kept by the harbour bo", "Room forty is kept by the harbour", "Room forty is kept by the harbour board,"]
    got = run(spark, rows + [(e, "b") for e in ends] + [("A longer text of the same source, which ends where it should.", "b")])
    assert [got[14 + i].cut for i in range(4)] == [False, True, True, True] and not any(got[i].cut for i in range(14))
    assert got[15].longer and got[16].end_rate < 0.1 and got[14].end_rate > 0.95


def test_a_last_word_of_one_letter_is_a_prefix_in_every_partition(spark):
    texts = [f"The {w} of hall {n} stands here." for w in ("stone", "sail", "ship", "sky", "stair", "slate") for n in range(8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "Desk: s"])], "id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        got = {r.id: r.longer for r in ending_evidence(df, df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[48] == 96 and not any(got[i] for i in range(48))


def test_a_longer_text_hides_no_limit(spark):
    padded = [("Word number %s is here. " % w * 9)[:90] for w in ("aa", "bb", "cc", "dd", "ee")]
    got = run(spark, [*((t, "limited") for t in padded), ("A much longer text is here. " * 9, "limited"), *(("w" * n + ".", "free") for n in (5, 5, 5, 7))])
    assert all(got[i].at_limit and got[i].cut for i in range(5)) and not any(got[i].at_limit for i in range(5, 10))
