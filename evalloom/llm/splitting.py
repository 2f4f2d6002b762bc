"""Cutting oversized texts at natural boundaries.

Method: the strength of the boundary after each word goes into a sparse table for range maxima. Each piece ends at the
strongest boundary of its window of permissible lengths, the rightmost of equals, and the next one starts `overlap`
words before that end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import WHITESPACE

_SPACE = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WHITESPACE)
_WORD = re.compile(f"[^{_SPACE}]+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")
_CLAUSE = re.compile(r"[,;:–—][\"'”’»)\]]*$")
PARAGRAPH, LINE, SENTENCE, CLAUSE = 4, 3, 2, 1


def boundary_strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """How natural a cut after each word is: paragraph end, line end, sentence end, clause end or none."""
    out = np.zeros(len(spans), np.int8)
    for k, (start, end) in enumerate(spans):
        gap = text[end : spans[k + 1][0]] if k + 1 < len(spans) else "\n\n"
        breaks = gap.count("\n") + gap.count("\u2028") + 2 * gap.count("\u2029")
        word = text[start:end]
        if breaks > 1:
            out[k] = PARAGRAPH
        elif breaks:
            out[k] = LINE
        elif _SENTENCE.search(word) and not text[spans[k + 1][0]].islower():
            out[k] = SENTENCE
        elif _CLAUSE.search(word):
            out[k] = CLAUSE
    return out


class RangeMaximum:
    """Where the largest of a range of up to `reach` values is, the rightmost of equals; built in n log reach, asked in constant time."""

    def __init__(self, values: np.ndarray, reach: int | None = None):
        self.values, self.table = values, [np.arange(len(values))]
        width = 1
        while 2 * width <= min(len(values), reach or len(values)):
            left, right = self.table[-1][: len(values) - 2 * width + 1], self.table[-1][width : len(values) - width + 1]
            self.table.append(np.where(values[right] >= values[left], right, left))
            width *= 2

    def argmax(self, low: int, high: int) -> int:
        """Of the positions low..high, both included."""
        level = (high - low + 1).bit_length() - 1
        left, right = self.table[level][low], self.table[level][high - (1 << level) + 1]
        return int(right if self.values[right] >= self.values[left] else left)


def cut_points(strengths: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Word ranges of at most `size` words that cover all words, each starting `overlap` words before the last one's end.

    A cut is sought in the second half of the permissible lengths, so that pieces don't get needlessly small, and in
    all of them if no sentence, line or paragraph ends there.
    """
    n, start, out = len(strengths), 0, []
    overlap = max(0, min(overlap, size - 1))
    index = RangeMaximum(strengths, size) if n > size else None
    while n - start > size:
        high = start + size - 1
        cut = index.argmax(max(start + overlap, start + size // 2), high)
        if strengths[cut] < SENTENCE:
            wide = index.argmax(start + overlap, high)
            cut = wide if strengths[wide] >= SENTENCE else cut
        out.append((start, cut + 1))
        start = cut + 1 - overlap
    out.append((start, n))
    return out


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for kind, key, text, size, overlap in batch[["kind", "key", "text", "size", "overlap"]].itertuples(index=False, name=None):
            spans = [m.span() for m in _WORD.finditer(text)]
            for ordinal, (a, b) in enumerate(cut_points(boundary_strengths(text, spans), int(size), int(overlap))):
                out.append((kind, key, ordinal, text[spans[a][0] : spans[b - 1][1]], a, b - a))
        yield pd.DataFrame(out, columns=["kind", "key", "ordinal", "text", "start_word", "n_words"])


def split_oversized(items: DataFrame) -> DataFrame:
    """Pieces of the items that have more than `size` words.

    `items`: `kind`, `key`, `text`, `size`, `overlap`. Result: kind, key, `ordinal` from 0, `text`, `start_word`,
    `n_words`. Items that fit aren't returned: they stay as they are. A null text has no words; an item whose size is
    null or less than 1 has no limit and stays whole; an overlap that is null counts as 0 and one of `size` or more
    as size - 1. Repeated rows are split once. A single word is never cut, however long.
    """
    big = items.select("kind", "key", "text", "size", F.coalesce("overlap", F.lit(0)).alias("overlap"))
    big = big.where((F.col("size") >= 1) & (F.regexp_count("text", F.lit(f"[^{WHITESPACE}]+")) > F.col("size"))).dropDuplicates()
    return big.mapInPandas(_split, "kind string, key string, ordinal int, text string, start_word int, n_words int")
