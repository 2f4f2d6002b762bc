"""How texts end: what the whole corpus says about a text's last words.

Two kinds of evidence are gathered over all texts and brought to each text by its own last words:

* the vocabulary trie: is the last word unknown elsewhere and a proper prefix of words that are known?
* endings: of all places where the last words occur, how many end a sentence, line, field or text?

Words are compared in lower case. The last words of the texts asked about are gathered first, and a Bloom filter of them,
of fixed size, tells each task which contexts are worth counting: one that passes by chance is counted for nothing, none
that is asked for is missed. Statistics are aggregates that combine before the shuffle; nothing of them is collected.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.canonical import distinct_texts
from evalloom.runtime import cut_lineage, join_weighted

#: A context with fewer occurrences than this says nothing.
MIN_SUPPORT = 12
LEVELS = 5
#: Words in a row that a task looks at together, and counts of contexts and of words it holds before it passes them on.
TOGETHER, HELD, WORDS_HELD = 100_000, 1_000_000, 300_000
#: 64-bit words of the filter of asked contexts, at most: 16 MB. Up to there each context has 16 bits or more.
FILTER_WORDS = 1 << 21

# What a word is apart from its letters, and what the gap after it is.
DIGIT, CAPITAL, SMALL = 1, 2, 4
ENDS, MAY_END, DOT, BLANK = 1, 2, 4, 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NUMBER, _NAME, _START, _DOT = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in ("#", "X", "^", "."))
_SPLIT = re.compile(r"([^\W_]+)").split


def _mixed(level: int, *hashes: np.ndarray) -> np.ndarray:
    out = np.full(len(hashes[0]), level + 1, np.uint64)
    for h in hashes:
        out = (out ^ h) * _MIX
        out ^= out >> np.uint64(29)
    return out


class Words(dict):
    """Numbers of words, and what is known of each: the word and its hash in lower case, and its class."""

    def __init__(self):
        self.lower: list[str] = []
        self.hashes: list[int] = []
        self.kinds: list[int] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.lower)
        self.lower.append(word.lower())
        self.hashes.append(xxhash.xxh3_64_intdigest(self.lower[-1]))
        c = word[0]
        self.kinds.append((DIGIT if any(map(str.isdigit, word)) else CAPITAL if c.isupper() else 0) | (SMALL if c.islower() or c.isdigit() else 0))
        return number


class Gaps(dict):
    """What a gap between words is: whether it ends a sentence, line or field, or does unless a small letter or digit follows, has a dot, or is blank."""

    def __missing__(self, gap: str) -> int:
        at = gap.find(".")
        ends = ENDS if any(x in gap for x in "\n;|!?…") else MAY_END if at >= 0 and any(x.isspace() for x in gap[at:]) else 0
        out = ends | (DOT if at >= 0 else 0) | (0 if gap.strip() else BLANK)
        if len(self) < 100_000:
            self[gap] = out
        return out


class Places:
    """The words of texts in a row. What a sentence, line or field before ended with doesn't count as before a word."""

    def __init__(self):
        self.words, self.gaps = Words(), Gaps()
        self.numbers: list[int] = []
        self.after: list[int] = []
        self.firsts: list[int] = []

    def __len__(self) -> int:
        return len(self.numbers)

    def clear(self) -> None:
        for x in (self.numbers, self.after, self.firsts):
            x.clear()
        if len(self.words) > 200_000:
            self.words = Words()

    def add(self, text: str) -> bool:
        """Whether there was a word in the text."""
        parts = _SPLIT(text)
        if len(parts) < 2:
            return False
        self.firsts.append(len(self.numbers))
        self.numbers.extend(map(self.words.__getitem__, parts[1::2]))
        self.after.extend(map(self.gaps.__getitem__, parts[2::2]))
        return True

    def arrays(self) -> None:
        """Makes the arrays that the others read: `number`, `kind`, `last`, `final`, `ends`, `before` and `gap`."""
        self.number, self.gap = np.array(self.numbers, np.int64), np.array(self.after, np.int8)
        self.hash, self.kind = np.array(self.words.hashes, np.uint64)[self.number], np.array(self.words.kinds, np.int8)[self.number]
        n, firsts = len(self), np.array(self.firsts, np.int64)
        self.last = np.zeros(n, bool)
        self.last[np.append(firsts[1:], n) - 1] = True
        self.final = self.last & (self.gap & BLANK > 0)
        self.ends = self.last | (self.gap & ENDS > 0) | ((self.gap & MAY_END > 0) & (np.roll(self.kind, -1) & SMALL == 0))
        begins = np.append(True, self.ends[:-1])
        # How many words of the same sentence, line or field stand before, two at most.
        self.before = np.minimum(np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0)), 2)

    def contexts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Level, places and the hash of each place's context of that level, most telling first.

        The context of a word are the two before it. All words with a digit are one. Shapes stand in for names and
        numbers, but only after other words; the one or two words that begin a sentence, line or field are compared with
        those that begin others.
        """
        kind = self.kind & (DIGIT | CAPITAL)
        form = np.where(kind == DIGIT, _NUMBER, self.hash)
        shape = np.where(kind == CAPITAL, _NAME, form)
        b1, b2, s1, s2, k1, k2 = (np.roll(x, n) for x in (form, shape, kind) for n in (1, 2))
        first, second, full = (np.flatnonzero(self.before == n) for n in range(3))
        yield 0, first, _mixed(0, np.full(len(first), _START), form[first])
        yield 0, second, _mixed(0, np.full(len(second), _START), b1[second], form[second])
        yield 0, full, _mixed(0, b2[full], b1[full], form[full])
        yield 1, full, _mixed(1, b1[full], form[full])
        # Of names and numbers alone nothing follows.
        plain, plain1, plain2 = kind[full] == 0, k1[full] == 0, k2[full] == 0
        at = full[plain | plain1 | plain2]
        yield 2, at, _mixed(2, s2[at], s1[at], shape[at])
        at = full[plain | plain1]
        yield 3, at, _mixed(3, s1[at], shape[at])
        at = full[plain]
        yield 4, at, _mixed(4, shape[at])
        dotted = np.flatnonzero(self.gap & DOT)
        yield LEVELS + 1, dotted, _mixed(LEVELS + 1, np.full(len(dotted), _DOT), self.hash[dotted])


def _filter_places(hashes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    one, mask = np.uint64(1), np.zeros(len(hashes), np.uint64)
    for shift in (0, 6, 12):
        mask |= one << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return ((hashes >> np.uint64(20)) % np.uint64(n_words)).astype(np.int64), mask


def _asked_filter(n_words: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = np.zeros(n_words, np.uint64)
    for batch in batches:
        at, mask = _filter_places(batch["context"].to_numpy(np.int64).view(np.uint64), n_words)
        np.bitwise_or.at(words, at, mask)
    yield pd.DataFrame({"words": [zlib.compress(words.tobytes(), 1)]})


def _count(asked, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts, passed on in parts: of each asked context, how often it ends something and how often it doesn't; of each word, how often it stands last in a text without punctuation and how often elsewhere."""
    words: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    places, held, n_held = Places(), [], 0

    def gather() -> None:
        nonlocal n_held
        wanted = asked.value
        places.arrays()
        for level, at, hashes in places.contexts():
            where, mask = _filter_places(hashes, len(wanted))
            hit = (wanted[where] & mask) == mask
            ends = places.ends[at[hit]]
            keys, inverse = np.unique(hashes[hit], return_inverse=True)
            held.append((keys, np.bincount(inverse, ends, len(keys)).astype(np.int64), np.bincount(inverse, ~ends, len(keys)).astype(np.int64)))
            n_held += len(keys)
        final = np.bincount(places.number, places.final, len(places.words.lower)).astype(np.int64)
        every = np.bincount(places.number, minlength=len(final))
        for number in np.flatnonzero(every).tolist():
            entry = words[places.words.lower[number]]
            entry[0] += int(final[number])
            entry[1] += int(every[number] - final[number])
        places.clear()

    def counted() -> pd.DataFrame:
        nonlocal n_held
        keys, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = [np.bincount(inverse, np.concatenate([h[i] for h in held]), len(keys)).astype(np.int64) for i in (1, 2)]
        held.clear()
        n_held = 0
        return pd.DataFrame({"word": None, "context": keys.view(np.int64), "n_end": sums[0], "n_mid": sums[1]})

    def vocabulary() -> pd.DataFrame:
        out = pd.DataFrame({"word": list(words), "context": 0, "n_end": [x[0] for x in words.values()], "n_mid": [x[1] for x in words.values()]})
        words.clear()
        return out

    for batch in batches:
        for text in batch["text"]:
            places.add(text)
            if len(places) > TOGETHER:
                gather()
                if n_held > HELD:
                    yield counted()
                if len(words) > WORDS_HELD:
                    yield vocabulary()
    if len(places):
        gather()
    if held:
        yield counted()
    if words:
        yield vocabulary()


def _walk_trie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks the trie of the partition's words depth first, which is their sorted order; on the path are the words that are prefixes of the present one.

    Gives the unknown words that are proper prefixes of others, with how often these occur. A word is unknown if it only
    ever stands last in a text without punctuation, and there once, or far more rarely than the longer words occur.
    """
    path: list[list] = []
    out: list[tuple[str, int]] = []

    def leave(word: str | None) -> None:
        while path and (word is None or not word.startswith(path[-1][0])):
            prefix, final, known, longer = path.pop()
            if final and not known and longer and (final == 1 or longer >= 20 * final):
                out.append((prefix, longer))

    for batch in batches:
        for word, final, known in zip(batch["word"], batch["n_end"], batch["n_mid"], strict=True):
            leave(word)
            for entry in path:
                entry[3] += known + final
            path.append([word, final, known, 0])
        if out:
            yield pd.DataFrame(out, columns=["word", "longer"])
            out.clear()
    leave(None)
    if out:
        yield pd.DataFrame(out, columns=["word", "longer"])


def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest("w" + word) - (1 << 63)


def _hashed_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"context": np.array([_word_hash(w) for w in batch["word"]], np.int64), "x": batch["longer"], "n": 1})


def _last_stretch(text: str) -> str:
    """The end of a text with its last three words whole, however long they are."""
    width = 256
    while width < len(text):
        parts = _SPLIT(text[-width:])
        # The first of four words may have lost its beginning.
        if len(parts) > 8:
            return "".join(parts[-7:])
        width *= 4
    return text


def _last_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    places = Places()
    for batch in batches:
        ids, ends = [], []
        for id_, text in zip(batch["id"], batch["text"], strict=True):
            if places.add(_last_stretch(text)):
                ids.append(id_)
                ends.append(len(places) - 1)
        if not ids:
            continue
        places.arrays()
        rows, levels = [np.arange(len(ids))], [np.full(len(ids), LEVELS)]
        found = [np.array([_word_hash(places.words.lower[n]) for n in places.number[ends].tolist()], np.int64)]
        row_of = np.full(len(places), -1)
        row_of[ends] = np.arange(len(ids))
        for level, at, hashes in places.contexts():
            hit = row_of[at] >= 0
            rows.append(row_of[at[hit]])
            levels.append(np.full(hit.sum(), level))
            found.append(hashes[hit].view(np.int64))
        order, exact = np.concatenate(rows), places.before[ends] == 2
        places.clear()
        yield pd.DataFrame({"id": pd.Series(ids, dtype=batch["id"].dtype).iloc[order].to_numpy(), "level": np.concatenate(levels), "context": np.concatenate(found), "exact": exact[order]})


def ending_evidence(corpus: DataFrame, asked: DataFrame, copies_count: bool = False) -> DataFrame:
    """What the corpus (`text`) says about the end of each of the texts asked about (`id`, `text`).

    Result: `id`, `end_rate` (of the most telling context with enough occurrences, the share that ends something; null if
    there is none), `exact` (whether that context is the last three words themselves), `dot_rate` (of the last word's occurrences before a full stop, the share where that ends a
    sentence; null if the text has no full stop after it or there are too few), `longer` (how often words occur of which
    the last word, unknown elsewhere, is a proper prefix; null if it is known or no such prefix). Texts without a word
    and null texts give no row. Repeated texts count once, unless `copies_count`: short replies are rightly the same.
    """
    asked = asked.select("id", "text").where("text is not null")
    corpus = corpus.select("text").where("text is not null")
    # Where texts come in copies, those of a cut text must not make its last word known. Only hashes of the texts meet to find them.
    if not copies_count:
        corpus = distinct_texts(corpus)
    kind = dict(asked.dtypes)["id"]
    last = cut_lineage(asked.mapInPandas(_last_words, f"id {kind}, level int, context long, exact boolean"))
    n_words = min(FILTER_WORDS, 1 << max(10, (last.count() // 4).bit_length()))
    filter_ = np.zeros(n_words, np.uint64)
    for row in last.where(f"level <> {LEVELS}").select("context").coalesce(last.sparkSession.sparkContext.defaultParallelism).mapInPandas(partial(_asked_filter, n_words), "words binary").toLocalIterator():
        filter_ |= np.frombuffer(zlib.decompress(row.words), np.uint64)
    wanted = last.sparkSession.sparkContext.broadcast(filter_)
    counted = corpus.mapInPandas(partial(_count, wanted), "word string, context long, n_end long, n_mid long")
    counts = cut_lineage(counted.groupBy("word", "context").agg(F.sum("n_end").alias("n_end"), F.sum("n_mid").alias("n_mid")).where(f"word is not null or n_end + n_mid >= {MIN_SUPPORT}"))
    words = counts.where("word is not null").select("word", "n_end", "n_mid")
    # A word of one letter is a prefix of words in many partitions: those are counted for each first letter.
    spelled = words.where("length(word) > 1")
    begun = spelled.groupBy(F.substring("word", 1, 1).alias("word")).agg(F.sum(F.col("n_end") + F.col("n_mid")).alias("longer"))
    letters = words.where("length(word) = 1 and n_mid = 0").join(begun, "word").where("n_end = 1 or longer >= 20 * n_end").select("word", "longer")
    suspicious = spelled.repartition(F.substring("word", 1, 2)).sortWithinPartitions("word").mapInPandas(_walk_trie, "word string, longer long").unionByName(letters)
    stats = counts.where("word is null").select("context", F.col("n_end").alias("x"), (F.col("n_end") + F.col("n_mid")).alias("n"))
    stats = cut_lineage(stats.unionByName(suspicious.mapInPandas(_hashed_words, "context long, x long, n long")))
    # Every level counts the same places again.
    total = stats.agg(F.sum("n")).first()[0] or 0
    found = join_weighted(last, stats, "context", "n", total, 1 << 14)
    rate = F.col("x") / F.col("n")
    rows = found.groupBy("id").agg(
        F.min(F.when(F.col("level") < LEVELS, F.struct("level", rate.alias("rate"), ((F.col("level") == 0) & F.col("exact")).alias("exact")))).alias("best"),
        F.max(F.when(F.col("level") == LEVELS, F.col("x"))).alias("longer"),
        F.max(F.when(F.col("level") == LEVELS + 1, rate)).alias("dot_rate"),
    )
    return rows.select("id", F.col("best.rate").alias("end_rate"), F.coalesce("best.exact", F.lit(False)).alias("exact"), "dot_rate", "longer")
