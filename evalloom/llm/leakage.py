"""Evaluation passages inside corpus documents.

Method: pigeonhole edit matching. A test item of n words is split into pieces of at most `piece_words` words, one more
than its error budget, so that a document with no more errors than that holds one piece unchanged; and a run of
2 * piece_words - 1 or more words shared with the item always contains a whole piece. Exact hits of pieces are found
with one automaton over all pieces, or by hash if there are too many, and each is verified with Myers' bit-parallel edit
distance, with words as symbols: of the words around the piece, and of the whole item. What that admits is checked
exactly, by extending the hit to the longest run of shared words around it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import spaced_words
from evalloom.runtime import cut_lineage

#: Characters of the items that are sought with one automaton in every task; more are sought by the hashes of their pieces.
MAX_CHARS = 16 << 20
#: 64-bit words of the filter of piece hashes: 16 MB.
FILTER_WORDS = 1 << 21


def split_pieces(n: int, piece_words: int) -> list[tuple[int, int]]:
    """Word ranges of equal length, but for one word, that cover n words with pieces of at most `piece_words`."""
    k = -(-n // piece_words)
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def myers_distance(pattern: list[str], text: list[str]) -> int:
    """The smallest number of words to insert, delete or replace to turn the pattern into a stretch of the text."""
    m = len(pattern)
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus_v, minus_v, score = ones, 0, m
    best = score
    for w in text:
        eq = where.get(w, 0)
        across = (((eq & plus_v) + plus_v) ^ plus_v) | eq
        plus_h, minus_h = minus_v | (ones & ~(across | plus_v)), plus_v & across
        if plus_h & top:
            score += 1
        elif minus_h & top:
            score -= 1
        best = min(best, score)
        plus_h, minus_h = (plus_h << 1) & ones, (minus_h << 1) & ones
        down = eq | minus_v
        plus_v, minus_v = minus_h | (ones & ~(down | plus_h)), plus_h & down
    return best


def verified(item: list[str], words: list[str], hits: list[tuple[int, int, int]], piece_words: int) -> tuple[int, int] | None:
    """Longest run and edit distance of an item in a document, given where its pieces lie (place in the document, place in the item, length); None if Myers' distance admits neither.

    A run of 2 * piece_words words with the piece in it needs the words around the piece to match but for those outside
    the run; the whole item may have as many errors as its budget.
    """
    n, run_words = len(item), 2 * piece_words
    budget = len(split_pieces(n, piece_words)) - 1
    admitted, longest, distance = False, 0, n
    reached: dict[int, int] = {}
    for first, a, size in hits:
        if reached.get(first - a, 0) > first:
            continue
        low, high = max(0, a + size - run_words), min(n, a + run_words)
        if high - low >= run_words and not admitted:
            admitted = myers_distance(item[low:high], words[max(0, first - a + low) : first - a + high]) <= high - low - run_words
        distance = min(distance, myers_distance(item, words[max(0, first - a - budget) : first - a + n + budget]))
        # The exact check: how far the run around the piece goes. Along one diagonal of item and document it is followed once.
        before = after = 0
        while before < min(a, first) and item[a - before - 1] == words[first - before - 1]:
            before += 1
        while a + after < n and first + after < len(words) and item[a + after] == words[first + after]:
            after += 1
        reached[first - a] = first + after
        longest = max(longest, before + after)
    return (longest, distance) if admitted or distance <= budget else None


def _search(items, piece_words: int):
    """Finds the pieces with one automaton over the items, which are a broadcast list of id and words."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worded = [(key, norm.split(" ")) for key, norm in items.value]
        automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for at, (_, words) in enumerate(worded):
            for a, b in split_pieces(len(words), piece_words):
                places[" " + " ".join(words[a:b]) + " "].append((at, a, b - a))
        for piece in places:
            automaton.add_word(piece, piece)
        if not places:
            return
        automaton.make_automaton()
        for batch in batches:
            out = []
            for doc, norm in zip(batch["doc"], batch["norm"], strict=True):
                hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
                text = f" {norm} "
                for end, piece in automaton.iter(text):
                    first = text.count(" ", 0, end - len(piece) + 2) - 1
                    for at, a, size in places[piece]:
                        hits[at].append((first, a, size))
                words = norm.split(" ") if hits else []
                for at, found in hits.items():
                    if result := verified(worded[at][1], words, found, piece_words):
                        out.append((doc, worded[at][0], *result, len(worded[at][1])))
            yield pd.DataFrame(out, columns=["doc", "item", "longest_run", "edit_distance", "item_words"])

    return search


def _piece_hash(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words))


def _pieces(piece_words: int):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(item, _piece_hash(words[a:b]), b - a) for item, norm in zip(batch["item"], batch["norm"], strict=True) for words in [norm.split(" ")] for a, b in split_pieces(len(words), piece_words)]
            items, hashes, sizes = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"item": pd.Series(items, dtype=batch["item"].dtype), "piece": np.array(hashes, np.uint64).view(np.int64), "size": np.array(sizes, np.int32)})

    return pieces


def _filter_bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, one = hashes.view(np.uint64), np.uint64(1)
    return ((h >> np.uint64(20)) % np.uint64(FILTER_WORDS)).astype(np.int64), (one << (h & np.uint64(63))) | (one << ((h >> np.uint64(6)) & np.uint64(63))) | (one << ((h >> np.uint64(12)) & np.uint64(63)))


def _piece_filter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = np.zeros(FILTER_WORDS, np.uint64)
    for batch in batches:
        at, mask = _filter_bits(batch["piece"].to_numpy(np.int64))
        np.bitwise_or.at(words, at, mask)
    yield pd.DataFrame({"words": [zlib.compress(words.tobytes(), 1)]})


def _documents_with_pieces(wanted, sizes: list[int]):
    """Documents with the hashes of their stretches that may be pieces; a Bloom filter loses none."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, norm in zip(batch["doc"], batch["norm"], strict=True):
                words = norm.split(" ")
                hashes = np.array([_piece_hash(words[k : k + size]) for size in sizes for k in range(len(words) - size + 1)], np.uint64).view(np.int64)
                at, mask = _filter_bits(hashes)
                found = np.unique(hashes[(wanted.value[at] & mask) == mask])
                if len(found):
                    out.append((doc, norm, found))
            yield pd.DataFrame(out, columns=["doc", "norm", "pieces"])

    return find


def _verify_pairs(piece_words: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, norm, key, item_norm in batch[["doc", "norm", "item", "item_norm"]].itertuples(index=False, name=None):
                words, item, places = norm.split(" "), item_norm.split(" "), defaultdict(list)
                for a, b in split_pieces(len(item), piece_words):
                    places[tuple(item[a:b])].append((a, b - a))
                hits = [(k, a, size) for length in {len(p) for p in places} for k in range(len(words) - length + 1) for a, size in places.get(tuple(words[k : k + length]), ())]
                if hits and (result := verified(item, words, sorted(hits), piece_words)):
                    out.append((doc, key, *result, len(item)))
            yield pd.DataFrame(out, columns=["doc", "item", "longest_run", "edit_distance", "item_words"])

    return verify


def find_leaks(documents: DataFrame, id_col: str, text: str, items: DataFrame, item_id: str, item_text: str, piece_words: int = 6, max_chars: int = MAX_CHARS) -> DataFrame:
    """Which items occur, wholly or partly, in which documents.

    One row a document and item that share a piece and either a run of 2 * piece_words words or the whole item with
    no more errors than its budget: id, item id, `longest_run` (shared words in a row), `edit_distance` (words, of the
    whole item to the closest stretch of the document) and `item_words`. Null and empty texts hold and match
    nothing; repeated rows of either table give one result; an item shorter than a piece is one piece.

    Items of up to `max_chars` characters in all go to every task, which seeks them in place. More are never gathered:
    their pieces meet the documents' stretches by hash, of which a Bloom filter lets few others through.
    """
    wanted = items.select(F.col(item_id).alias("item"), spaced_words(F.col(item_text)).alias("norm")).where("norm <> '' and item is not null").dropDuplicates()
    docs = documents.select(F.col(id_col).alias("doc"), spaced_words(F.col(text)).alias("norm")).where("norm <> ''")
    kinds, context = {"doc": dict(documents.dtypes)[id_col], "item": dict(items.dtypes)[item_id]}, documents.sparkSession.sparkContext
    schema = f"doc {kinds['doc']}, item {kinds['item']}, longest_run int, edit_distance int, item_words int"
    chars = wanted.agg(F.sum(F.length("norm"))).first()[0] or 0
    if chars <= max_chars:
        rows = docs.mapInPandas(_search(context.broadcast([tuple(r) for r in wanted.collect()]), piece_words), schema)
    else:
        pieces = cut_lineage(wanted.mapInPandas(_pieces(piece_words), f"item {kinds['item']}, piece long, size int").distinct())
        words = np.zeros(FILTER_WORDS, np.uint64)
        for row in pieces.select("piece").coalesce(context.defaultParallelism).mapInPandas(_piece_filter, "words binary").toLocalIterator():
            words |= np.frombuffer(zlib.decompress(row.words), np.uint64)
        sizes = sorted(r[0] for r in pieces.select("size").distinct().collect())  # piece_words at most
        held = cut_lineage(docs.mapInPandas(_documents_with_pieces(context.broadcast(words), sizes), f"doc {kinds['doc']}, norm string, pieces array<long>").withColumn("row", F.monotonically_increasing_id()))
        pairs = held.select("row", F.explode("pieces").alias("piece")).join(pieces, "piece").select("row", "item").distinct()
        rows = pairs.join(held.select("row", "doc", "norm"), "row").join(wanted.withColumnRenamed("norm", "item_norm"), "item").mapInPandas(_verify_pairs(piece_words), schema)
    budget = F.ceil(F.col("item_words") / piece_words) - 1
    rows = rows.where((F.col("longest_run") >= 2 * piece_words) | (F.col("edit_distance") <= budget))
    best = rows.groupBy("doc", "item").agg(F.max("longest_run").alias("longest_run"), F.min("edit_distance").alias("edit_distance"), F.max("item_words").alias("item_words"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), "longest_run", "edit_distance", "item_words")
