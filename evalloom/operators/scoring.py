"""Retrieval: scores of chunks for questions, and the best of them.

The questions of a suite are a stated set of queries against all its chunks. Both are cut into blocks; a block of
questions meets a block of chunks in one task, which scores them as a product of matrices, a tile of chunks at a time,
and passes on the k best of each question. So no row per question and chunk is ever shuffled, and a word that every
question and every chunk has costs an addition, not a row. Scores are ranked after rounding to nine digits, as sums
depend on their order in the last bits; ties go to the smaller chunk id, and only scores above zero are hits.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import hashed_bucket, hashed_sign, tokens
from evalloom.operators.corpus import with_suite
from evalloom.operators.index import document_frequency_of, postings_of, run_lengths, stats_of, term_idf, tokenized
from evalloom.runtime import broadcast_if_small, cut_lineage
from evalloom.sources.contract import ContractError

K1, B = 1.5, 0.75
SLOTS = 128
MAX_LIMIT = 1000
STRATEGIES = ("overlap", "bm25", "tfidf", "hashing", "hybrid")
#: Questions and chunks that meet in one task, and chunks scored at once.
QUESTIONS_TOGETHER, CHUNKS_TOGETHER, TILE = 2048, 4096, 512
#: Vectors and cosines below this are zero but for rounding.
NOISE = 1e-12
RESULT = "suite_id string, question_id string, chunk_id string, score double, lexical_score double, vector_score double, ranked_by double"


class Index:
    """Tokens, statistics and terms of the chunks, and the terms of the questions; each is made when first asked for, once."""

    def __init__(self, chunks: DataFrame, questions: DataFrame):
        self._chunks, self._questions = chunks, questions

    def check(self) -> Index:
        """An error if the index has no chunk, or two of a suite with one id."""
        ids = self._chunks.groupBy("suite_id", "chunk_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("chunks"), F.max("n").alias("most")).first()
        if not ids.chunks:
            raise ContractError("an index needs a chunk")
        if ids.most > 1:
            raise ContractError("chunk ids must be unique")
        return self

    @cached_property
    def token_lists(self) -> DataFrame:
        # Documents are validated, cut and tokenised once for all that follows.
        return cut_lineage(tokenized(self._chunks))

    @cached_property
    def posted(self) -> DataFrame:
        return postings_of(self.token_lists)

    @cached_property
    def stats(self) -> DataFrame:
        return cut_lineage(stats_of(self.token_lists))  # one row a suite

    @cached_property
    def terms(self) -> DataFrame:
        return cut_lineage(term_idf(document_frequency_of(self.token_lists), self.stats))

    @cached_property
    def asked(self) -> DataFrame:
        """suite_id, question_id, token and `qtf` of the questions."""
        listed = self._questions.select("suite_id", "question_id", tokens(F.col("text")).alias("tokens"))
        return cut_lineage(run_lengths(listed, "tokens", "suite_id", "question_id").withColumnRenamed("tf", "qtf"))

    @cached_property
    def weighed(self) -> DataFrame:
        """Chunks with their tokens, each with `tf`, `idf`, slot and sign, as one array a chunk."""
        # Hashed once a term, not once a posting.
        known = self.terms.select("suite_id", "token", F.col("tfidf_idf").alias("idf"), hashed_bucket(F.col("token")).alias("slot"), hashed_sign(F.col("token")).alias("sign"))
        rows = self.posted.join(broadcast_if_small(known, 200_000), ["suite_id", "token"])
        return cut_lineage(rows.groupBy("suite_id", "chunk_id").agg(F.collect_list(F.struct("token", "tf", "idf", "slot", "sign")).alias("terms")))

    def queries(self, strategy: str) -> DataFrame:
        """suite_id, question_id, `tokens` with `weights`, the `divisor` of their sum, `slots` with `values`."""
        rows = self.asked
        if strategy == "overlap":
            rows = rows.withColumns({"weight": F.lit(1.0), "part": F.lit(1.0)})
        else:
            rows = rows.join(broadcast_if_small(self.terms, 200_000).drop("df"), ["suite_id", "token"], "left")
            idf = F.col("tfidf_idf")
            if strategy == "tfidf":
                rows = rows.withColumns({"weight": F.col("qtf") * idf * idf, "part": F.pow(F.col("qtf") * idf, 2)})
            else:
                rows = rows.withColumns({"weight": F.col("bm25_idf"), "part": F.lit(None).cast("double")})
        columns = {"token": F.col("token"), "weight": F.coalesce("weight", F.lit(0.0))}
        if strategy in ("hashing", "hybrid"):
            # A token that the index doesn't know weighs 1.
            columns |= {"slot": hashed_bucket(F.col("token")), "value": hashed_sign(F.col("token")) * F.col("qtf") * F.coalesce("tfidf_idf", F.lit(1.0))}
        entry = F.struct(*(v.alias(k) for k, v in columns.items()))
        divisor = {"overlap": F.sum("part"), "tfidf": F.sqrt(F.sum("part"))}.get(strategy, F.lit(1.0))
        listed = rows.groupBy("suite_id", "question_id").agg(F.collect_list(entry).alias("e"), divisor.alias("divisor"))
        vector = (F.col("e.slot"), F.col("e.value")) if "slot" in columns else (F.lit(None).cast("array<int>"), F.lit(None).cast("array<double>"))
        return listed.select("suite_id", "question_id", F.array_join("e.token", " ").alias("tokens"), F.col("e.weight").alias("weights"), "divisor", vector[0].alias("slots"), vector[1].alias("values"))

    def targets(self, strategy: str) -> DataFrame:
        """suite_id, chunk_id, `text` (tokens, repeated ones too), `norm`, `slots` with `values`; `norm` is the suite's mean length for BM25."""
        nothing = (F.lit(None).cast("array<int>").alias("slots"), F.lit(None).cast("array<double>").alias("values"))
        plain = self.token_lists.select("suite_id", "chunk_id", F.array_join("tokens", " ").alias("text"))
        if strategy == "overlap":
            return plain.select("*", F.lit(1.0).alias("norm"), *nothing)
        means = broadcast_if_small(self.stats).select("suite_id", F.col("avg_length").alias("norm"))
        if strategy == "bm25":
            return plain.join(means, "suite_id").select("suite_id", "chunk_id", "text", "norm", *nothing)
        words = F.array_join(F.flatten(F.transform("terms", lambda t: F.array_repeat(t["token"], t["tf"]))), " ").alias("text")
        if strategy == "tfidf":
            norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + F.pow(t["tf"] * t["idf"], 2)))
            return self.weighed.select("suite_id", "chunk_id", words, norm.alias("norm"), *nothing)
        values = F.transform("terms", lambda t: t["sign"] * t["tf"] * t["idf"]).alias("values")
        return self.weighed.join(means, "suite_id").select("suite_id", "chunk_id", words, "norm", F.col("terms.slot").alias("slots"), values)


def _unit_vectors(slots: pd.Series, values: pd.Series) -> np.ndarray:
    """Dense vectors of length 1; those that cancelled out stay zero."""
    lengths = np.fromiter(map(len, slots), np.int64, len(slots))
    at = np.repeat(np.arange(len(slots)) * SLOTS, lengths) + np.concatenate([*slots, np.zeros(0, np.int64)])
    dense = np.bincount(at.astype(np.int64), np.concatenate([*values, np.zeros(0)]), len(slots) * SLOTS).reshape(-1, SLOTS)
    norms = np.sqrt((dense * dense).sum(1, keepdims=True))
    return np.divide(dense, norms, out=np.zeros_like(dense), where=norms > NOISE)


def _first_of_rows(rows: np.ndarray, cols: np.ndarray, by: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Positions of the k[row] entries of each row that come first by falling `by`, then by column."""
    order = np.lexsort((cols, -by, rows))
    sorted_rows = rows[order]
    starts = np.searchsorted(sorted_rows, sorted_rows)
    return order[np.arange(len(order)) - starts < k[sorted_rows]]


def _score_block(strategy: str):
    lexical, vector = strategy != "hashing", strategy in ("hashing", "hybrid")

    def block(key: tuple, questions: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        found: list[np.ndarray] = []
        k = questions["retrieval_k"].fillna(0).to_numpy(np.int64)
        chunks = chunks.sort_values("chunk_id", ignore_index=True)
        n, vocabulary = len(questions), {}
        asked = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in text.split(" ")], np.int64) for text in questions["tokens"]]
        weights, divisors = list(questions["weights"]), questions["divisor"].to_numpy(float)
        threshold = np.zeros(n)
        if vector and n:
            own, share = _unit_vectors(questions["slots"], questions["values"]), questions["hybrid_weight"].to_numpy(float)[:, None]
        for first in range(0, len(chunks) if n and k.max() > 0 else 0, TILE):
            tile = chunks.iloc[first : first + TILE]
            width = len(tile)
            words, cosines = np.zeros((n, width)), np.zeros((n, width))
            if lexical:
                split = [text.split(" ") for text in tile["text"]]
                at = [vocabulary[t] * width + j for j, listed in enumerate(split) for t in listed if t in vocabulary]
                tf = np.bincount(np.array(at, np.int64), minlength=len(vocabulary) * width).reshape(-1, width).astype(float)
                if strategy == "overlap":
                    tf = (tf > 0).astype(float)
                elif strategy == "tfidf":
                    tf /= tile["norm"].to_numpy(float)
                else:
                    lengths = np.array([len(listed) for listed in split], float)
                    tf = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / tile["norm"].to_numpy(float)))
                for q in range(n):
                    words[q] = weights[q] @ tf[asked[q]]
                words /= np.where(divisors > 0, divisors, 1.0)[:, None]
            if vector:
                cosines = own @ _unit_vectors(tile["slots"], tile["values"]).T
                cosines[cosines < NOISE] = 0.0
            scores = words if not vector else cosines if not lexical else share * words / (1 + words) + (1 - share) * cosines
            rounded = np.round(scores, 9)
            most = min(int(k.max()), width)
            # Below the k-th best of a tile nothing can be among the k best of all.
            threshold = np.maximum(threshold, np.where(k == k.max(), np.partition(rounded, width - most, 1)[:, width - most] if most == k.max() else 0.0, 0.0))
            rows, cols = np.nonzero((rounded >= threshold[:, None]) & (scores > 0))
            best = _first_of_rows(rows, cols, rounded[rows, cols], k)
            rows, cols = rows[best], cols[best]
            found.append(np.stack([rows, cols + first, scores[rows, cols], words[rows, cols], cosines[rows, cols], rounded[rows, cols]]))
        rows, cols, *values = np.concatenate([np.zeros((6, 0)), *found], 1)
        rows, cols = rows.astype(np.int64), cols.astype(np.int64)
        best = _first_of_rows(rows, cols, values[3], k)
        names = ("score", "lexical_score", "vector_score", "ranked_by")
        return pd.DataFrame({"suite_id": key[0], "question_id": questions["question_id"].to_numpy()[rows[best]], "chunk_id": chunks["chunk_id"].to_numpy()[cols[best]], **{name: v[best] for name, v in zip(names, values, strict=True)}})

    return block


def retrieve(strategy: str, index: Index, suites: DataFrame) -> DataFrame:
    """The suite's `retrieval_k` best chunks of each question, with `rank` from 1; only positive scores, and only `suites`.

    A question or chunk without tokens, or of another suite, has no hit; a null `retrieval_k` asks for none.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {sorted(STRATEGIES)}")
    limits = suites.agg(F.min("retrieval_k"), F.max("retrieval_k")).first()
    if any(k is not None and not 1 <= k <= MAX_LIMIT for k in limits):
        raise ContractError(f"retrieval_k must be a whole number from 1 to {MAX_LIMIT}")
    weight = F.col("hybrid_weight") if "hybrid_weight" in suites.columns else F.lit(0.5)
    settings = suites.select("suite_id", "retrieval_k", F.coalesce(weight, F.lit(0.5)).alias("hybrid_weight"))
    questions, chunks = index.queries(strategy), index.targets(strategy)
    # A suite is cut into as many blocks of each side as its size asks for.
    sizes = index.asked.select("suite_id", "question_id").distinct().groupBy("suite_id").agg(F.ceil(F.count("*") / QUESTIONS_TOGETHER).cast("int").alias("q"))
    sizes = broadcast_if_small(cut_lineage(sizes.join(index.stats.select("suite_id", F.ceil(F.col("n_chunks") / CHUNKS_TOGETHER).cast("int").alias("c")), "suite_id").join(settings, "suite_id")))
    spread = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    own = lambda name, column: F.pmod(F.xxhash64(name), F.col(column)).cast("int")
    left = questions.join(sizes, "suite_id").withColumn("q_block", own("question_id", "q")).withColumn("c_block", spread("c")).drop("q", "c")
    right = chunks.join(sizes.drop("retrieval_k", "hybrid_weight"), "suite_id").withColumn("c_block", own("chunk_id", "c")).withColumn("q_block", spread("q")).drop("q", "c")
    spark, by = left.sparkSession, ["suite_id", "q_block", "c_block"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    scored = left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *by).groupBy(*by)).applyInPandas(_score_block(strategy), RESULT)
    order = Window.partitionBy("suite_id", "question_id").orderBy(F.desc("ranked_by"), "chunk_id")
    return with_suite(scored.withColumn("rank", F.row_number().over(order)), suites, "retrieval_k").where("rank <= retrieval_k").drop("retrieval_k", "ranked_by")
