"""The N best items of every group.

Method: sorted runs merged by a loser tree. The rows of a group are spread over the partitions by (group, item), so a
group of any size is cut into many runs. Each partition sorts its rows by group and score and passes on the first N of
each group, seeking to the next group after that: these are the sorted runs. The runs are stored by bucket of the group
in the shuffle, ordered by group, run and score, and each bucket merges the runs of one group after the other with a
loser tree, again seeking to the next group after N outputs. A group brings N rows a run at most to the merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LoserTree:
    """Merges sorted runs: `pop` gives the smallest head of all; each costs one comparison a level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        return self.runs[a][self.at[a]] <= self.runs[b][self.at[b]]

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = lost
        return won

    def pop(self):
        """The next item, or None when all runs are used up."""
        run = self.winner
        if run < 0 or self.at[run] >= len(self.runs[run]):
            return None
        item = self.runs[run][self.at[run]]
        self.at[run] += 1
        node = (run + self.k) // 2
        while node >= 1:
            if not self._beats(run, self.losers[node]):
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.winner = run
        return item


def _cut_runs(n: int):
    """Of batches sorted by group, the first `n` rows of each group."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, had = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("g")
            encoded = groups.dictionary_encode()
            codes = np.asarray(encoded.indices.fill_null(-1))
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            lengths = np.diff(np.append(starts, len(codes)))
            place = np.arange(len(codes)) - np.repeat(starts, lengths)
            if groups[0].as_py() == last:
                place[: lengths[0]] += had
            last, had = groups[-1].as_py(), int(place[-1]) + 1
            yield batch.filter(pa.array(place < n))

    return cut


def _merge_runs(n: int):
    """Of rows sorted by group, run and place in the run, the `n` first of each group by falling score, then item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("g", "run", "s", "i")), strict=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.float64()), pa.array([r[3] for r in out], pa.int32())], names=["g", "i", "s", "place"])
        for group, members in groupby(rows(batches), key=lambda r: r[0]):
            # UTF-8 bytes sort by code point, as Spark compares strings.
            runs = [[(-r[2], r[3].encode(), r[3]) for r in run] for _, run in groupby(members, key=lambda r: r[1])]
            tree = LoserTree(runs)
            for place in range(1, n + 1):
                if (item := tree.pop()) is None:
                    break
                out.append((group, item[2], -item[0] + 0.0, place))
            if len(out) >= 8192:
                yield pack()
                out.clear()
        if out:
            yield pack()

    return merge


def latest_scores(df: DataFrame, group: str, item: str, score: str, at: str) -> DataFrame:
    """One row a (group, item): the score of the row with the latest `at`, of those the highest score.

    Rows without a group, an item or a score (null or NaN) are left out first; a null `at` is earlier than any other.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"), F.col(at).alias("t"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    return rows.groupBy("g", "i").agg(F.max(F.struct("t", "s")).alias("m")).select("g", "i", F.col("m.s").alias("s"))


def top_n(scored: DataFrame, n: int) -> DataFrame:
    """Of rows `g`, `i` (strings, neither null) and `s`, the `n` best of each `g` by falling `s`, then by `i` in code-point order; adds `place` from 1.

    Equal rows count apart: callers that want an item once make it unique first. An infinite score sorts as it
    compares. A group with fewer than `n` rows gives all of them; an empty table gives none.
    """
    order: list[Column | str] = ["g", F.col("s").desc(), "i"]
    runs = scored.select("g", "i", "s").sortWithinPartitions(*order).mapInArrow(_cut_runs(n), "g string, i string, s double")
    runs = runs.withColumn("run", F.spark_partition_id())
    stored = runs.repartition("g").sortWithinPartitions("g", "run", F.col("s").desc(), "i")
    return stored.select("g", "run", "s", "i").mapInArrow(_merge_runs(n), "g string, i string, s double, place int")
