"""Texts that share most of their wording.

Similarity of two texts is the share of the distinct three-word runs of either that are found in both.

Method: multi-index Hamming join. A text's signature has 32 symbols of 16 bits, each the smallest of its runs under one
hash function, so that two texts of similarity J differ in about (1 - J) * 32 symbols. Signatures are split into 8 chunks
of 4 symbols. By the pigeonhole principle two signatures at a distance of 15 or less have a chunk with at most one
wrong symbol; enumerating which one may be wrong gives 4 keys a chunk, and all such pairs meet in a key. Pairs further
apart often do so too: one of similarity 0.6 meets with probability 0.994, of 0.7 with 0.9998. With each key go the
number of runs and the signature with 4 bits a symbol, by which what meets is told before it is shuffled: texts whose
numbers of runs rule the similarity out, and signatures that differ in more symbols than MAX_DISTANCE, which is beyond
the distance guaranteed. The runs themselves decide in the end, so that every pair given is a true one.

Copies are joined once: texts with the same words in the same order are one variant, and only variants are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.canonical import with_canonical_keys
from evalloom.runtime import broadcast_if_small, cut_lineage

RUN_WORDS = 3
CHUNKS, CHUNK_SYMBOLS, CHUNK_ERRORS = 8, 4, 1
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: Two signatures that differ in so many symbols or fewer have a chunk with no more errors than are enumerated.
GUARANTEED = CHUNKS * (CHUNK_ERRORS + 1) - 1
#: Differing symbols of 4 bits beyond which a candidate is dropped: 4 standard deviations above the mean of similarity 0.6.
MAX_DISTANCE = 23
#: Members of one variant that one task expands.
EXPANDED_TOGETHER = 20_000

_WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1 << 62, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class RunHasher:
    """64-bit hashes of the runs of texts; the hashes of words are remembered, up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        n = max(0, len(h) - RUN_WORDS + 1)
        out = np.zeros(n, np.uint64)
        for k in range(RUN_WORDS):
            out = _mixed(out * _MIX + h[k : k + n])
        return out


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = RunHasher()
    for batch in batches:
        kept, variants, runs = [], [], []
        for at, text in enumerate(batch["text"]):
            words = _WORD.findall(text.lower())
            if len(words) >= RUN_WORDS:
                kept.append(at)
                variants.append(_variant(words))
                runs.append(hasher(words))
        if not kept:
            continue
        flat = np.concatenate(runs)
        starts = np.cumsum([0] + [len(r) for r in runs[:-1]])
        symbols = np.empty((len(kept), SYMBOLS), np.uint16)
        for k in range(SYMBOLS):
            lowest = np.minimum.reduceat(flat * _MULTIPLIERS[k] + _OFFSETS[k], starts)
            symbols[:, k] = _mixed(lowest) >> np.uint64(48)
        # Repeated runs count once.
        sizes = [len(np.unique(r)) for r in runs]
        yield pd.DataFrame({"kind": batch["kind"].to_numpy()[kept], "key": batch["key"].to_numpy()[kept], "variant": variants, "n_runs": sizes, "sig": [row.tobytes() for row in symbols]})


def _short(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the signatures, and these with 4 bits each, packed into two longs: one for each half of the chunks."""
    symbols = np.frombuffer(b"".join(batch["sig"]), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
    halves = symbols.reshape(-1, 2, SYMBOLS // 2) & np.uint64(15)
    return symbols, (halves << (np.arange(SYMBOLS // 2, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def _chunk_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each chunk and each choice of symbols that may be wrong in it, a hash of the others; with it go the short signature and the number of runs."""
    for batch in batches:
        if not len(batch):
            continue
        symbols, halves = _short(batch)
        kind = np.array([xxhash.xxh3_64_intdigest(k) for k in batch["kind"]], np.uint64)
        keys = []
        for chunk in range(CHUNKS):
            for wrong in range(CHUNK_SYMBOLS):
                x = kind + np.uint64(chunk * CHUNK_SYMBOLS + wrong)
                for k in range(CHUNK_SYMBOLS):
                    if k != wrong:
                        x = _mixed(x * _MIX + symbols[:, chunk * CHUNK_SYMBOLS + k] + np.uint64(1))
                keys.append(x)
        again = lambda column: np.repeat(column, len(keys))
        yield pd.DataFrame({"key": np.stack(keys, 1).ravel().view(np.int64), "rid": again(batch["rid"].to_numpy()), "s0": again(halves[:, 0]), "s1": again(halves[:, 1]), "n_runs": again(batch["n_runs"].to_numpy())})


def _variant(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of the texts that are of the variant asked for: a key may have texts of several."""
    hasher = RunHasher()
    for batch in batches:
        worded = [_WORD.findall(text.lower()) for text in batch["text"]]
        same = [_variant(words) == variant for words, variant in zip(worded, batch["variant"], strict=True)]
        runs = [np.unique(hasher(words)).view(np.int64) for words, ok in zip(worded, same, strict=True) if ok]
        yield batch.loc[same, ["rid", "letters_key", "fields_key"]].assign(runs=runs)


def _differing(a: str, b: str) -> Column:
    """How many of the 16 four-bit symbols of two longs differ."""
    x = F.col(a).bitwiseXOR(F.col(b))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def may_be_close(threshold: float) -> Column:
    """Whether two keyed rows, `l` and `r`, can be similar: the smaller has enough runs for it, and the signatures differ in few enough symbols."""
    sizes = F.least("l.n_runs", "r.n_runs") >= threshold * F.greatest("l.n_runs", "r.n_runs")
    return sizes & (_differing("l.s0", "r.s0") + _differing("l.s1", "r.s1") <= MAX_DISTANCE)


class NearDuplicates:
    """`links`: pairs of variants, `a` < `b`, with their similarity. `members`: kind, key and `rid` of the variant of every text with a run, and `n`, the members of that variant."""

    def __init__(self, links: DataFrame, members: DataFrame):
        self.links, self.members = links, members

    def pairs(self) -> DataFrame:
        """kind, low_key, high_key of all pairs of linked texts. A variant of many members is expanded in many tasks: it is salted by its size."""
        salts = F.ceil(F.col("n") / EXPANDED_TOGETHER).cast("int")
        sizes = self.members.select("rid", salts.alias("salts")).where("salts > 1").distinct()
        members = self.members.select("rid", "kind", "key", F.pmod(F.xxhash64("key"), salts).cast("int").alias("salt"))
        rows = self.links.select("a", "b")
        for side in ("a", "b"):
            spread = rows.join(sizes.withColumnRenamed("rid", side), side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
            own = members.select(F.col("rid").alias(side), "salt", F.col("kind").alias(f"{side}_kind"), F.col("key").alias(f"{side}_key"))
            rows = spread.join(own, [side, "salt"]).drop("salt")
        rows = rows.select(F.col("a_kind").alias("kind"), F.least("a_key", "b_key").alias("low_key"), F.greatest("a_key", "b_key").alias("high_key"))
        return rows.where("low_key <> high_key").distinct()

    def groups(self) -> DataFrame:
        """kind, key, `group_id` (the smallest key of its group) and `links` (how many other variants its own is linked with) of every text."""
        both = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy(F.col("a").alias("rid")).agg(F.count("*").alias("links"))
        labels = connected_components(self.links.select("a", "b"))
        # A label and a count a variant; names are found by variant first, so that a hot one is one row.
        least = self.members.groupBy("rid").agg(F.min("key").alias("least"))
        named = least.join(labels, "rid", "left").join(degree, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
        names = named.groupBy("label").agg(F.min("least").alias("group_id"))
        known = cut_lineage(named.join(names, "label").select("rid", "group_id", F.coalesce("links", F.lit(0)).alias("links")))
        return self.members.join(known, "rid").select("kind", "key", "group_id", "links")


def connected_components(edges: DataFrame) -> DataFrame:
    """`rid` and `label`, the smallest rid of its component, for every end of an edge (`a`, `b`).

    Large-star and small-star rounds until nothing changes: both are aggregates by node, and edges never multiply.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours larger than the node go to the smallest of its surroundings.
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), F.col("b")).where("a <> b").distinct()
        # Small star: the node and its smaller neighbours go to the smallest of these.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(down.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = cut_lineage(small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == last:
            return edges.select(F.col("b").alias("rid"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("rid"), F.col("a").alias("label")).distinct())
        last = now


def find_near_duplicates(items: DataFrame, threshold: float = 0.6) -> NearDuplicates:
    """Near-duplicates among `items`: `kind`, `key` (strings), `text` and `fields` (whether the order of fields counts as formatting).

    Only texts of one kind are compared. Texts with fewer than three words, null and empty ones among them, have no
    runs and are left out. Pairs whose letters and digits are the same are no near-duplicates but copies; where
    `fields` is true, so are those with the same fields in another order. Rows repeated in full count once; other
    columns are ignored.
    """
    items = items.select("kind", "key", "text", "fields").where("text is not null and key is not null")
    signed = cut_lineage(items.mapInPandas(_sign, "kind string, key string, variant binary, n_runs int, sig binary"))
    variants = signed.groupBy("kind", "variant").agg(F.min("key").alias("key"), F.first("n_runs").alias("n_runs"), F.first("sig").alias("sig"), F.count("*").alias("n"))
    variants = cut_lineage(variants.withColumn("rid", F.monotonically_increasing_id()))
    members = signed.select("kind", "key", "variant").distinct().join(variants.select("kind", "variant", "rid", "n"), ["kind", "variant"]).drop("variant")

    # What meets by chance in a key is told before it is shuffled. A key that many have is split by the skew handling of the join.
    keyed = variants.select("rid", "kind", "n_runs", "sig").mapInPandas(_chunk_keys, "key long, rid long, s0 long, s1 long, n_runs int")
    met = keyed.alias("l").join(keyed.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.rid") < F.col("r.rid")) & may_be_close(threshold))
    close = cut_lineage(met.select(F.col("l.rid").alias("a"), F.col("r.rid").alias("b")).distinct())

    ends = close.select(F.col("a").alias("rid")).unionByName(close.select(F.col("b").alias("rid"))).distinct()
    wanted = cut_lineage(variants.join(ends, "rid").select("kind", "key", "rid", "variant"))
    texts = items.join(broadcast_if_small(wanted, 200_000), ["kind", "key"])
    texts = with_canonical_keys(texts, "text").withColumn("fields_key", F.when(F.col("fields"), F.col("fields_key")))
    runs = texts.select("rid", "variant", "text", "letters_key", "fields_key").mapInPandas(_runs, "rid long, letters_key binary, fields_key binary, runs array<long>").dropDuplicates(["rid"])
    pairs = close
    for side in ("a", "b"):
        pairs = pairs.join(runs.select(F.col("rid").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("letters_key", "fields_key", "runs"))), side)
    shared = F.size(F.array_intersect("a_runs", "b_runs"))
    similarity = shared / (F.size("a_runs") + F.size("b_runs") - shared)
    pairs = pairs.where("a_letters_key <> b_letters_key and not coalesce(a_fields_key = b_fields_key, false)")
    links = pairs.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    return NearDuplicates(cut_lineage(links), members)
