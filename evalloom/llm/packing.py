"""Filling containers of fixed capacity with texts of varying length.

Method: sizes are whole numbers up to the capacity, so the instance is a histogram of at most `capacity` counts, which
is all the driver sees. On it, Martello and Toth's dominance fixes sets of one or two sizes that no other set can beat,
for all items of these sizes at once, and shrinks the histogram; best fit, largest first, packs the rest. The result is
a list of patterns with their numbers of containers. Texts then find their container by their rank among the texts of
their size, without any grouping by container.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.text import ascii_token_count
from evalloom.runtime import cut_lineage

Pattern = tuple[tuple[int, int], ...]
#: About how many rows of one size are ranked in one task.
RANKED_TOGETHER = 50_000


def _reachable(sizes: list[int], upto: int) -> int:
    """Bit v is set if v is a sum of two or more of the sizes, each used any number of times."""
    limit = (1 << (upto + 1)) - 1
    sums, two = 1, 0
    single = sum(1 << s for s in sizes if s <= upto)
    while True:
        grown = sums
        for s in sizes:
            if s <= upto:
                grown |= (grown << s) & limit
        if grown == sums:
            break
        sums = grown
    for s in sizes:
        if s <= upto:
            two |= ((sums & ~1) << s) & limit
    return two & limit if single else 0


def dominance_reduction(counts: np.ndarray) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """Fixes the dominating sets of one or two items; gives them with their numbers, and the counts that are left.

    A size s with no partner that fits is alone. Otherwise let p be the largest that fits beside s. Every other set
    with s is dominated by {s, p} if the rest of that set always fits in the place of p: when s + p fills the
    container, or when no sum of two or more sizes lies between p and the room beside s.
    """
    capacity, counts, fixed = len(counts) - 1, counts.copy(), []
    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while counts[s]:
                room = capacity - s
                there = [q for q in np.flatnonzero(counts[1 : room + 1]) + 1 if q != s or counts[s] > 1]
                if not there:
                    fixed.append((((s, 1),), int(counts[s])))
                    counts[s], changed = 0, True
                    break
                p = int(max(there))
                if p != room and (_reachable([int(q) for q in there], room) >> (p + 1)) != 0:
                    break
                times = int(counts[s] // 2 if p == s else min(counts[s], counts[p]))
                fixed.append((((s, 2),) if p == s else ((s, 1), (p, 1)), times))
                counts[s] -= times
                counts[p] -= times
                changed = True
    return fixed, counts


def best_fit(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Packs the counts largest first, each item where the least room is left; equal containers are handled together."""
    capacity = len(counts) - 1
    open_: dict[int, dict[Pattern, int]] = defaultdict(dict)

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            open_[room][pattern] = open_[room].get(pattern, 0) + n

    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            room = min((r for r, there in open_.items() if r >= s and there), default=None)
            if room is None:
                room, pattern, n = capacity, (), left
            else:
                pattern = next(iter(open_[room]))
                n = open_[room].pop(pattern)
            each = room // s
            full = min(n, left // each)
            put(room - each * s, (*pattern, (s, each)), full)
            left, n = left - full * each, n - full
            if n and left < each:
                if left:
                    put(room - left * s, (*pattern, (s, left)), 1)
                left, n = 0, n - bool(left)
            if pattern:
                put(room, pattern, n)
    return [(pattern, n) for there in open_.values() for pattern, n in there.items()]


def plan_containers(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Patterns (size, how often) and how many containers each fills; `counts[s]` items have the size s."""
    fixed, rest = dominance_reduction(counts)
    return fixed + best_fit(rest)


def pack_texts(df: DataFrame, id_col: str, text: str, capacity: int = 512) -> DataFrame:
    """The container of every text, or of every piece of a text of more than `capacity` tokens.

    Tokens are longest runs of two or more ASCII letters and digits. Result: id, `piece` from 0, `n_pieces`,
    `first_token`, `n_tokens`, `container`. A null or empty text has no tokens and takes no room; these are dealt out
    over the containers (all to container 0 if there is no other). Rows repeated in full are packed each on its own.
    """
    sized = df.select(F.col(id_col).alias("id"), ascii_token_count(F.col(text)).alias("tokens"))
    sized = sized.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int"))
    pieces = sized.select("id", "tokens", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int"))
    pieces = cut_lineage(pieces.select("id", "piece", "n_pieces", "size"))
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in pieces.groupBy("size").count().toLocalIterator():
        counts[size] = n
    empty, counts[0] = int(counts[0]), 0
    patterns = plan_containers(counts)
    total = sum(n for _, n in patterns)

    # Slots of each size in order: from rank `low` on, the first container and how many items each takes.
    used, slots, base = defaultdict(int), [], 0
    for pattern, n in patterns:
        for s, each in pattern:
            slots.append((s, used[s], base, each))
            used[s] += n * each
        base += n
    slots.sort()
    keys = np.array([(s << 48) + low for s, low, _, _ in slots] or [0], np.int64)
    bases, per = (np.array([x[i] for x in slots] or [1], np.int64) for i in (2, 3))

    @F.pandas_udf(T.LongType())
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        s, r = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.clip(np.searchsorted(keys, (s << 48) + r, side="right") - 1, 0, None)
        found = bases[at] + (r - (keys[at] & ((1 << 48) - 1))) // per[at]
        return pd.Series(np.where(s == 0, r % max(total, 1), found))

    # Rank among the pieces of a size: salted, so that a size that many pieces share is ranked in many tasks.
    salts = max(1, int(max(counts.max(), empty) // RANKED_TOGETHER))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    blocks = salted.groupBy("size", "salt").count()
    before = blocks.select("size", "salt", (F.sum("count").over(Window.partitionBy("size").orderBy("salt")) - F.col("count")).alias("before"))
    within = salted.withColumn("nth", F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "piece")))
    ranked = within.join(before, ["size", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    return ranked.select(F.col("id").alias(id_col), "piece", "n_pieces", (F.col("piece") * capacity).alias("first_token"), F.col("size").alias("n_tokens"), container("size", "rank").alias("container"))
