"""Records that differ only in formatting.

Two contents are the same if their letters and digits, in lower case and in order, are the same. Contents made only of
three or more `name: value` or `name = value` fields also count as the same if they hold the same fields in any order.

Method: every record is reduced to 128-bit canonical hashes. Each partition builds two Bloom filters over them, one of
the hashes it has seen and one of those it has seen again; the filters are merged segment by segment (what is in both
of two partitions' first filters goes to the second). Records whose hashes are not in the merged second filter are
singletons and are never shuffled; the others, the possible repeats, are grouped exactly. A Bloom filter has no false
negatives, so nothing is lost; a false positive only sends a singleton through the exact grouping. A filter keeps 16 bits
a hash: what is too many for one is cut into bands of contents with the same counts of letters, filtered in turn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.text import ALNUM, digest16, letters_only
from evalloom.runtime import cut_lineage, join_weighted

#: Words of 64 bits in a segment of a filter; a segment is what the merging step holds at once.
SEGMENT_WORDS = 8192
#: Upper bound of one merged filter, which is sent to the executors. More hashes are filtered band by band.
MAX_FILTER_BYTES = 64 << 20
BITS_PER_HASH = 16
# What may stand between the fields of a content.
SEPARATORS = "\\r\\n\\x{85}\\x{2028}\\x{2029}\\x{B}\\x{C};|"


def field_parts(content: Column) -> Column:
    """The parts of a content between line breaks, semicolons and bars that hold a letter or digit."""
    parts = F.split(F.coalesce(content, F.lit("")), f"[{SEPARATORS}]+")
    return F.filter(parts, lambda p: p.rlike(f"[{ALNUM}]"))


def with_canonical_keys(df: DataFrame, content: str) -> DataFrame:
    """Adds `letters_key`, the hash of the letters and digits in order, and `fields_key`, the hash of the sorted fields (null unless the content consists of three or more fields).

    A null content counts as an empty one. A part is a field if a name of at most 60 characters, with a letter and
    without sentence punctuation, stands before the first colon or equals sign that is not between two digits, and a
    letter or digit after it.
    """
    # Most contents are prose: the fields are split only where there are enough separators and name marks.
    field = f"^[^:=.!?]{{0,60}}?\\p{{L}}[^:=.!?]{{0,60}}?(?:=|(?<!\\d):|:(?!\\d))(?s:.*)[{ALNUM}]"
    may_be = (F.regexp_count(content, F.lit("[:=]")) >= 3) & (F.regexp_count(content, F.lit(f"[{SEPARATORS}]")) >= 2)
    parts = F.when(may_be, field_parts(F.col(content)))
    is_fields = (F.size(parts) >= 3) & F.forall(parts, lambda p: p.rlike(field))
    fields = F.array_join(F.array_sort(F.transform(parts, letters_only)), "\x01")
    return df.withColumns({"letters_key": digest16(letters_only(F.col(content))), "fields_key": F.when(is_fields, digest16(F.concat(F.lit("\x01"), fields)))})


def _positions(hashes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter and the mask of four bits in it that belong to each hash."""
    h = hashes.view(np.uint64)
    one = np.uint64(1)
    mask = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= one << ((h >> np.uint64(shift)) & np.uint64(63))
    return ((h >> np.uint64(24)) % np.uint64(n_words)).astype(np.int64), mask


def _build_filters(n_words: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, again = np.zeros(n_words, np.uint64), np.zeros(n_words, np.uint64)
        for batch in batches:
            hashes, counts = np.unique(batch["h"].to_numpy(np.int64), return_counts=True)
            at, mask = _positions(hashes, n_words)
            seen = (counts > 1) | ((once[at] & mask) == mask)
            np.bitwise_or.at(again, at[seen], mask[seen])
            np.bitwise_or.at(once, at, mask)
        for segment in range(0, n_words, SEGMENT_WORDS):
            a, b = once[segment : segment + SEGMENT_WORDS], again[segment : segment + SEGMENT_WORDS]
            if a.any():
                yield pd.DataFrame({"segment": [segment // SEGMENT_WORDS], "once": [zlib.compress(a.tobytes(), 1)], "again": [zlib.compress(b.tobytes(), 1)]})

    return build


def _merge_filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges the rows of each segment, which come one after the other; one segment is held at a time."""
    current, once, again = None, None, None
    done = lambda: pd.DataFrame({"segment": [current], "again": [zlib.compress(again.tobytes(), 1)]})
    for batch in batches:
        for segment, a, b in zip(batch["segment"], batch["once"], batch["again"], strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint64) for x in (a, b))
            if segment != current:
                if current is not None:
                    yield done()
                current, once, again = segment, np.zeros_like(a), np.zeros_like(a)
            again = again | b | (once & a)
            once = once | a
    if current is not None:
        yield done()


def repeated_hash_filter(hashes: DataFrame, n_words: int) -> np.ndarray:
    """The merged Bloom filter of the hashes (column `h`) that occur more than once, as `n_words` 64-bit words."""
    spark = hashes.sparkSession
    partial = hashes.coalesce(spark.sparkContext.defaultParallelism).mapInPandas(_build_filters(n_words), "segment int, once binary, again binary")
    n_segments = max(1, n_words // SEGMENT_WORDS)
    merged = partial.repartition(min(n_segments, 64), "segment").sortWithinPartitions("segment").mapInPandas(_merge_filters, "segment int, again binary")
    out = np.zeros(n_words, np.uint64)
    for row in merged.toLocalIterator():  # MAX_FILTER_BYTES at most
        out[row.segment * SEGMENT_WORDS :][:SEGMENT_WORDS] = np.frombuffer(zlib.decompress(row.again), np.uint64)
    return out


def n_bands(n_rows: int, max_bytes: int = MAX_FILTER_BYTES) -> int:
    """How many filters of `max_bytes` give the hashes of so many rows their bits."""
    return max(1, -(-n_rows * BITS_PER_HASH // (8 * max_bytes)))


def mark_repeats(rows: DataFrame, probes: list[Column], band: Column, n_rows: int, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Adds `__may`: whether one of a row's hashes (`probes`, null ones left out) may occur in another row too.

    Every hash gets BITS_PER_HASH bits. Where one filter of `max_bytes` can't give them, rows are written in bands,
    without a shuffle, and each band has a filter of its own, one after the other; `band` is an integer that rows
    sharing a probe have in common.
    """
    most, bands = max_bytes // 8, n_bands(n_rows, max_bytes)
    n_words = min(1 << (max(SEGMENT_WORDS, n_rows * BITS_PER_HASH // (64 * bands)) - 1).bit_length(), most)

    def marked(part: DataFrame) -> DataFrame:
        found = repeated_hash_filter(part.select(F.explode(F.array_compact(F.array(*probes))).alias("h")), n_words)
        words = part.sparkSession.sparkContext.broadcast(found)

        @F.pandas_udf(T.BooleanType())
        def may_repeat(*hashes: pd.Series) -> pd.Series:
            hit = np.zeros(len(hashes[0]), bool)
            for column in hashes:
                at, mask = _positions(column.to_numpy(np.int64), n_words)
                hit |= (words.value[at] & mask) == mask
            return pd.Series(hit)

        # A missing hash counts as the first, which is never null.
        return part.withColumn("__may", may_repeat(*(F.coalesce(p, probes[0]) for p in probes)))

    if bands == 1:
        return marked(rows)
    banded = cut_lineage(rows.withColumn("__band", F.pmod(band, F.lit(bands)).cast("int")), "__band")
    return reduce(DataFrame.unionByName, [cut_lineage(marked(banded.where(F.col("__band") == b).drop("__band"))) for b in range(bands)])


def distinct_texts(df: DataFrame) -> DataFrame:
    """`text`, each once: only texts whose hash may occur twice are shuffled."""
    rows = df.select("text").where("text is not null")
    own = F.xxhash64("text")
    marked = mark_repeats(rows, [own], own, rows.count())
    return marked.where("not __may").select("text").unionByName(marked.where("__may").select("text").distinct())


class CanonicalGroups:
    """The outcome of grouping records by canonical content.

    `members`: of the records with at least one copy, id, `first_id` (smallest id of the group), `copies` (size of the
    group) and the columns kept. `singles`: id and kept columns of the others.
    """

    def __init__(self, members: DataFrame, singles: DataFrame, id_col: str):
        self.members, self.singles, self.id_col = members, singles, id_col

    def collapsed(self) -> DataFrame:
        """One row a content: `first_id` and `copies`."""
        groups = self.members.where(F.col(self.id_col) == F.col("first_id")).select("first_id", "copies")
        return groups.unionByName(self.singles.select(F.col(self.id_col).alias("first_id"), F.lit(1).cast("long").alias("copies")))


def group_by_canonical_content(df: DataFrame, id_col: str, content: str, keep: tuple[str, ...] = (), max_filter_bytes: int = MAX_FILTER_BYTES) -> CanonicalGroups:
    """Groups the rows of `df` whose contents are the same but for formatting.

    Rows with a null or blank content, or one without letters and digits, form one group. `id_col` must be unique;
    a row without an id belongs to no group and is left out. An empty table gives empty groups. Columns other than
    `id_col`, `content` and `keep` are ignored, whatever their names.
    """
    # The order of fields changes no count of letters, so that contents which are the same are in one band.
    letters = letters_only(F.col("__content"))
    counts = (F.length(letters), *(F.length(F.translate(letters, x, "")) for x in ("e", "n", "0123456789")))
    own = df.where(F.col(id_col).isNotNull())
    total = own.count()
    band = F.xxhash64(*counts) if n_bands(total, max_filter_bytes) > 1 else F.lit(0)
    rows = with_canonical_keys(own.select(F.col(id_col).alias("__id"), F.col(content).alias("__content"), *(F.col(c).alias(f"__k_{c}") for c in keep)), "__content").withColumn("__band", band).drop("__content")
    rows = cut_lineage(rows)
    probes = [F.xxhash64("letters_key"), F.when(F.col("fields_key").isNotNull(), F.xxhash64("fields_key"))]
    marked = mark_repeats(rows, probes, F.col("__band"), total, max_filter_bytes).drop("__band")
    marked = marked.withColumn("__key", F.concat("letters_key", F.coalesce("fields_key", F.unhex(F.lit("")))))
    possible = cut_lineage(marked.where("__may"))
    # Exact grouping of the possible repeats; copies are counted before the shuffle, so that a hot group is a few rows.
    contents = possible.groupBy("__key", "letters_key", "fields_key").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    spelled = contents.where(F.col("fields_key").isNotNull()).groupBy("letters_key").agg(F.min("fields_key").alias("__same"))
    contents = contents.join(spelled, "letters_key", "left").withColumn("__root", F.coalesce("__same", "letters_key"))
    roots = contents.groupBy("__root").agg(F.min("__first").alias("first_id"), F.sum("__n").alias("copies"))
    keyed = contents.join(roots, "__root").select("__key", "__n", "first_id", "copies")
    kept = [F.col(f"__k_{c}").alias(c) for c in keep]
    found = cut_lineage(join_weighted(possible, cut_lineage(keyed), "__key", "__n", total).select(F.col("__id").alias(id_col), "first_id", "copies", *kept))
    lone = found.where("copies = 1").select(id_col, *keep)
    singles = marked.where(~F.col("__may")).select(F.col("__id").alias(id_col), *kept).unionByName(lone)
    return CanonicalGroups(found.where("copies > 1"), singles, id_col)
