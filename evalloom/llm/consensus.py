"""The value of a field closest to what a duplicate group's records agree on.

Method: the different values of a group are aligned progressively, token by token, the heaviest first; every column of
the alignment is a vote, weighted by the records that stand behind each token or the gap; the existing value with the
fewest token edits to the consensus is the one that survives. Aligning ends as soon as the weight still to come can turn
no column. The guide tree of a field with many different values has lanes of values, aligned first, and then the lanes.

An order of preference leaves nothing to vote on: the first record that has a value decides alone (`preferred_values`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.runtime import cut_lineage

#: Different values of one group and field that one task aligns; more are aligned in parts, and the parts with one another.
ALIGNED_TOGETHER = 512

_TOKEN = re.compile(r"\w+|[^\w\s]")
Column = dict[str, float]


def tokenize(value: str) -> list[str]:
    return _TOKEN.findall(value)


def merge(profile: list[Column], other: list[Column]) -> list[Column]:
    """Aligns two profiles so that the tokens brought together weigh most, and adds their votes column by column."""
    n, m = len(profile), len(other)
    where: dict[str, list[int]] = {}
    for j, b in enumerate(other):
        for t in b:
            where.setdefault(t, []).append(j)
    match: list[dict[int, float]] = []
    for a in profile:
        row: dict[int, float] = {}
        for t, w in a.items():
            for j in where.get(t, ()):
                row[j] = row.get(j, 0) + min(w, other[j][t])
        match.append(row)
    best = [[0] * (m + 1)]
    for row in match:
        above, line = best[-1], [0]
        for j in range(m):
            line.append(max(above[j] + row.get(j, 0), above[j + 1], line[j]))
        best.append(line)
    out, i, j = [], n, m
    while i or j:
        if i and j and (gain := match[i - 1].get(j - 1, 0)) > 0 and best[i][j] == best[i - 1][j - 1] + gain:
            i, j = i - 1, j - 1
            out.append({t: profile[i].get(t, 0) + other[j].get(t, 0) for t in profile[i] | other[j]})
        elif i and (not j or best[i][j] == best[i - 1][j]):
            i -= 1
            out.append(profile[i])
        else:
            j -= 1
            out.append(other[j])
    return out[::-1]


def settled(profile: list[Column], done: float, rest: float) -> bool:
    """Whether votes of the weight `rest` can change no column of a profile of the weight `done`, nor make one."""
    if done <= rest:
        return False
    for column in profile:
        second, first = sorted([0, *column.values(), done - sum(column.values())])[-2:]
        if first - second <= rest:
            return False
    return True


def agree(members: list[tuple[list[Column], float]], whole: bool) -> tuple[list[Column], float]:
    """The profile of all members, heaviest first, and their weight; if they are the `whole` group, votes that come too late to change it are left out."""
    total = sum(w for _, w in members)
    profile, done = members[0]
    for other, weight in members[1:]:
        if whole and settled(profile, done, total - done):
            break
        profile, done = merge(profile, other), done + weight
    return profile, done if whole else total


def vote(profile: list[Column], total: float) -> list[str]:
    """The token of each column that outweighs every other and the gap."""
    out = []
    for column in profile:
        token, weight = min(column.items(), key=lambda x: (-x[1], x[0]))
        if weight > total - sum(column.values()):
            out.append(token)
    return out


def distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _fold(last: bool):
    """Folds the profiles of each group, field and lane, which come one after the other, into one; the `last` fold gives what they agree on."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch[["set", "field_name", "lane", "lanes", "profile", "weight", "place"]].itertuples(index=False, name=None))
        out: list[tuple] = []
        for (group, field, lane), listed in groupby(rows, key=lambda r: r[:3]):
            first = list(listed)
            members = [(json.loads(packed), weight) for *_, packed, weight, _ in first]
            profile, total = agree(members, last or first[0][3] == 1)
            out.append((group, field, lane, first[0][3], json.dumps(vote(profile, total) if last else profile), float(total), first[0][6]))
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=["set", "field_name", "lane", "lanes", "profile", "weight", "place"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["set", "field_name", "lane", "lanes", "profile", "weight", "place"])

    return fold


@F.pandas_udf(T.StringType())
def _single(value: pd.Series, weight: pd.Series) -> pd.Series:
    return pd.Series([json.dumps([{t: w} for t in tokenize(v)]) for v, w in zip(value, weight, strict=True)])


@F.pandas_udf(T.IntegerType())
def _edits(value: pd.Series, agreed: pd.Series) -> pd.Series:
    return pd.Series([distance(tokenize(v), json.loads(a)) for v, a in zip(value, agreed, strict=True)], dtype="int32")


def _survivors(listed: DataFrame, kind: str) -> DataFrame:
    """Of `set`, `field_name`, `value`, `weight`, `id` and `place` (an array by which the heaviest value comes first), one row a value: the value closest to the consensus of each set and field, with `edits`."""
    sizes = listed.groupBy("set", "field_name").agg(F.ceil(F.count("*") / ALIGNED_TOGETHER).cast("int").alias("lanes"))
    values = cut_lineage(listed.join(sizes, ["set", "field_name"]))
    place = dict(values.dtypes)["place"]
    schema = f"set {kind}, field_name string, lane int, lanes int, profile string, weight double, place {place}"
    lane = F.pmod(F.xxhash64("value"), F.col("lanes")).cast("int")
    parts = values.select("set", "field_name", lane.alias("lane"), "lanes", _single("value", "weight").alias("profile"), "weight", "place")
    by = ("set", "field_name", "lane", "place")
    several = parts.where("lanes > 1").repartition(*by[:3]).sortWithinPartitions(*by).mapInPandas(_fold(False), schema).withColumn("lane", F.lit(0))
    folded = parts.where("lanes = 1").unionByName(several)
    agreed = folded.repartition("set", "field_name").sortWithinPartitions(*by).mapInPandas(_fold(True), schema)
    judged = values.join(agreed.select("set", "field_name", F.col("profile").alias("agreed")), ["set", "field_name"]).withColumn("edits", _edits("value", "agreed"))
    best = judged.groupBy("set", "field_name").agg(F.min(F.struct("edits", "place", "value", "id", "weight")).alias("b"))
    return best.select("set", "field_name", "b.value", "b.id", "b.edits", "b.weight")


def preferred_values(listed: DataFrame, set_col: str) -> DataFrame:
    """The value of the first record of each `set_col` and `field_name` in the order of `rank`, `age` (integers) and `id`; `value` is a string, not null.

    Result: set_col, `field_name`, `value`, `from_record_id`. If one id has several values in the same place, the
    smallest counts. Nothing is aligned: the order alone decides, in one aggregate that is begun before the shuffle.
    """
    first = listed.groupBy(set_col, "field_name").agg(F.min(F.struct("rank", "age", "id", "value")).alias("f"))
    return first.select(set_col, "field_name", "f.value", F.col("f.id").alias("from_record_id"))


def consensus_values(members: DataFrame, set_col: str, id_col: str, weight: str, fields: tuple[str, ...]) -> DataFrame:
    """For each set and field the existing value closest to the weighted consensus.

    Result: set_col, `field_name`, `value`, `from_record_id` (the smallest id with it), `edits` (tokens between it and
    the consensus) and `votes` (weight behind it). Of equally close values the heavier survives, then the one with the
    smaller id. Null and blank values have no vote, and a field without any gives no row; rows repeated in full vote
    once; a null weight is 0. Values are counted before anything is shuffled, and never more than ALIGNED_TOGETHER of
    them are aligned in one step.
    """
    listed = members.select(F.col(set_col).alias("set"), F.col(id_col).alias("id"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields))).alias("f")).distinct()
    listed = listed.select("set", "id", "w", "f.*").where("value is not null and trim(value) <> ''")
    values = listed.groupBy("set", "field_name", "value").agg(F.sum("w").alias("weight"), F.min("id").alias("id"))
    values = values.withColumn("place", F.struct((-F.col("weight")).alias("against"), "id"))
    best = _survivors(values, dict(members.dtypes)[set_col])
    return best.select(F.col("set").alias(set_col), "field_name", "value", F.col("id").alias("from_record_id"), "edits", F.col("weight").alias("votes"))
