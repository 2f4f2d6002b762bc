import random
from collections import Counter

import numpy as np
import pytest

from evalloom.llm.canonical import _build_filters, _merge_filters, _positions, distinct_texts, group_by_canonical_content


def groups(spark, contents, extra=""):
    rows = [(i, c) for i, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "record_id long, content string").selectExpr("*", "'x' as __id", "1 as first_id", "2 as h", "'y' as letters_key")
    found = group_by_canonical_content(df, "record_id", "content")
    members = {r.record_id: (r.first_id, r.copies) for r in found.members.collect()}
    singles = {r.record_id for r in found.singles.collect()}
    collapsed = {r.first_id: r.copies for r in found.collapsed().collect()}
    assert len(members) + len(singles) == len(contents) == sum(collapsed.values())
    return members, singles, collapsed


def test_formatting_and_field_order(spark):
    members, singles, collapsed = groups(spark, ["Hello, World 1", "hello   world-1!", "hello world 2", "A: one\nB: two\nC: three", "b = two; c = three; a = one", "c: three | a: one", "ZWISCHEN ÜBER", "zwischen über", "zwischen uber"])
    assert members[1] == (0, 2) and members[4] == (3, 2) and members[7] == (6, 2)
    assert singles == {2, 5, 8} and len(collapsed) == 6


def test_times_are_no_fields(spark):
    prose = ["Opens at 9:00 today\nCloses at 8:15 then\nRests at 7:30 now", "Closes at 8:15 then\nOpens at 9:00 today\nRests at 7:30 now"]
    assert groups(spark, prose)[1] == {0, 1}


def test_fields_and_the_same_letters_in_prose(spark):
    """A card without its separators is the same as the card, and so as the card in another order."""
    members, _, _ = groups(spark, ["a: one\nb: two\nc: three", "a one b two c three", "c: three; b: two; a: one"])
    assert {m[0] for m in members.values()} == {0} and len(members) == 3


def test_nulls_blanks_and_long_texts(spark):
    long = "word " * 300_000
    members, singles, _ = groups(spark, [None, "", " \n", "—", long, long.upper() + ".", "x: " * 50_000, "y"])
    assert {members[i] for i in range(4)} == {(0, 4)} and members[5] == (4, 2) and singles == {6, 7}


def test_empty_table_and_missing_ids(spark):
    assert groups(spark, []) == ({}, set(), {})
    df = spark.createDataFrame([(None, "a"), (1, "a"), (2, "A")], "record_id long, content string")
    assert group_by_canonical_content(df, "record_id", "content").members.count() == 2


def test_hot_group_keeps_every_row(spark):
    contents = [f"Text {i % 7}" if i % 3 else "the hot one" for i in range(900)]
    members, singles, collapsed = groups(spark, contents)
    assert not singles and sorted(collapsed.values(), reverse=True)[0] == 300 and members[897] == (0, 300)


@pytest.mark.parametrize("parts", [1, 4])
def test_filter_has_no_false_negatives(parts):
    import pandas as pd

    rng = random.Random(parts)
    hashes = [rng.getrandbits(63) for _ in range(3000)]
    repeated = set(hashes[:500])
    stream = hashes + list(repeated)
    rng.shuffle(stream)
    rows = []
    for k in range(parts):
        rows += list(_build_filters(8192)(iter([pd.DataFrame({"h": stream[k::parts]})])))
    words = np.frombuffer(__import__("zlib").decompress(next(_merge_filters(iter([pd.concat(rows)])))["again"].iloc[0]), np.uint64)
    at, mask = _positions(np.array(hashes, np.int64), 8192)
    hit = (words[at] & mask) == mask
    assert hit[:500].all() and hit[500:].mean() < 0.05


def test_bands_of_a_filter_lose_nothing(spark):
    rng = random.Random(5)
    texts = [f"Text number {rng.randrange(260)} of the {rng.choice(['old', 'new'])} hall" for _ in range(300)]
    texts += [sep.join(rng.sample([f"Name: {n}", f"Fee: {n} marks", "Hall: old"], 3)) for n in range(40) for sep in ("\n", "; ")]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    whole, banded = (Counter((r.id, r.first_id, r.copies) for r in group_by_canonical_content(df, "id", "text", max_filter_bytes=n).members.collect()) for n in (1 << 20, 128))
    assert whole == banded and len(whole) > 200
    assert Counter(r.text for r in distinct_texts(df).collect()) == Counter(set(texts))


def test_every_member_of_many_small_groups_is_kept(spark):
    cards = [(2 * n + k, f"Name: N{n}; Fee: {n}; Hall: old" if k else f"Fee: {n}\nHall: old\nName: N{n}") for n in range(1020) for k in (0, 1)]
    groups = group_by_canonical_content(spark.createDataFrame(cards, "id long, text string"), "id", "text")
    assert groups.members.count() == 2040 and groups.collapsed().count() == 1020
