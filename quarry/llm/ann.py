"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Rotations are learned on a bounded sample so that the signs of the turned, centred vectors quantise them well; each gives
one substring of a code. Every block of rows has an index for each substring: its values and the rows of each. Of two
codes within a radius, some substring is within radius // substrings; probing the values that near in every index finds
each code within the radius. What is found is ranked by the original vectors. Queries meet the rows block by block; a
query that finds too few rows within the radius, over all blocks, meets all rows without the index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .vectors import usable

#: Rows on which rotations and radius are fitted, the first by a hash of the key.
SAMPLE = 10_000
#: Rows and queries that meet in a task. Substrings of a code, each of at most 64 bits.
ROWS_BLOCK, QUERIES_BLOCK, SUBSTRINGS = 16_384, 4096, 4


class Model:
    """Mean, rotations and radius, for vectors of one length. The radius holds ``recall`` of the sample's pairs that are as
    near, among the sample's rows, as the k nearest are among ``n`` rows."""

    def __init__(self, x: np.ndarray, n: int, k: int, recall: float, seed: int = 7, rounds: int = 25):
        self.dim = x.shape[1]
        self.mean = x.mean(axis=0)
        y = x - self.mean
        self.bits = min(64, self.dim)
        basis = np.linalg.eigh(y.T @ y)[1][:, ::-1][:, : self.bits]
        p = y @ basis
        self.turns = []
        for s in range(SUBSTRINGS):
            r = np.linalg.qr(np.random.default_rng([seed, s]).normal(size=(self.bits, self.bits)))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(p @ r >= 0, 1.0, -1.0).T @ p)
                r = (u @ w).T
            self.turns.append(basis @ r)
        self.radius = SUBSTRINGS * self.bits
        k = min(-(-k * len(x) // max(n, 1)), len(x) - 1)
        if k < 1:
            return
        code = self.codes(x)
        asked = np.arange(0, len(x), max(1, len(x) // 1000))
        near = x[asked] @ x.T
        near[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        apart = np.bitwise_count(code[asked][:, None] ^ code[best]).sum(axis=2)
        self.radius = int(np.quantile(apart, recall, method="higher"))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of words for each vector, one a substring."""
        out = np.zeros((len(x), SUBSTRINGS), np.uint64)
        for s, turn in enumerate(self.turns):
            packed = np.packbits((x - self.mean) @ turn >= 0, axis=1, bitorder="little")
            out[:, s] = np.pad(packed, ((0, 0), (0, 8 - packed.shape[1]))).view(np.uint64).ravel()
        return out


class Index:
    """The multi-index of a block: for every substring its values, and by value the rows that have it."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.values, self.rows, self.starts = [], [], []
        for s in range(code.shape[1]):
            value, place = np.unique(code[:, s], return_inverse=True)
            self.values.append(value)
            self.rows.append(np.argsort(place, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(value)))]))

    def within(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
        """All rows whose code is within radius of q, and how many were probed for it."""
        found = np.zeros(len(self.code), bool)
        for s, word in enumerate(q):
            probe = np.flatnonzero(np.bitwise_count(self.values[s] ^ word) <= radius // len(q))
            start = self.starts[s][probe]
            many = self.starts[s][probe + 1] - start
            if len(probe):
                step = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
                found[self.rows[s][np.arange(many.sum()) + step]] = True
        at = np.flatnonzero(found)
        return at[np.bitwise_count(self.code[at] ^ q).sum(axis=1) <= radius], len(at)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores in order, ties to the smaller id."""
    at = np.arange(len(ids))
    if len(ids) > k:
        at = np.flatnonzero(score >= np.partition(score, len(ids) - k)[len(ids) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def search(
    vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.95,
    sample: int = SAMPLE, rows_block: int = ROWS_BLOCK, queries_block: int = QUERIES_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest found by inner product, ties to the smaller key.

    A query's own key is no candidate. Vectors null, empty, zero or with a null or non-finite component and rows with a
    null key take no part; vectors of unlike lengths never meet. Every row is indexed; only rotations and radius come
    from ``sample`` rows of the most common length. Vectors of other lengths, and queries with fewer than k rows within
    the radius in all blocks together, are searched without the index, so that the result does not depend on blocks.
    Repeated rows are candidates each; repeated queries are one query, and rows of one key with unlike vectors are
    queries of their own under that key. No queries or no rows: an empty result. Other columns are left out.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
        return df.where(usable("_v") & F.col("_k").isNotNull())

    rows, asked = clean(vectors), clean(queries).withColumn("_q", F.xxhash64("_k", "_v")).dropDuplicates(["_k", "_q"])
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    (dim, n), = sizes.items()
    some = rows.where(F.size("_v") == dim).orderBy(F.xxhash64("_k", F.lit(11)), "_k").limit(sample).select("_v").toPandas()
    model = spark.sparkContext.broadcast(Model(np.stack(some["_v"].to_numpy()), n, k, recall))
    found = common.cut(_meet(rows, asked, k, model, True, rows_block, queries_block))
    counts = found.groupBy("query_id", "_q").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    few = common.cut(asked.join(counts, (F.col("_k") == F.col("query_id")) & (asked["_q"] == counts["_q"]), "left_anti"))
    if not few.isEmpty():
        again = _meet(rows, few, k, model, False, rows_block, queries_block)
        found = found.join(counts, ["query_id", "_q"], "left_semi").union(again)
    order = W.partitionBy("query_id", "_q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(rows: DataFrame, asked: DataFrame, k: int, model, indexed: bool, rows_block: int, queries_block: int) -> DataFrame:
    """(query_id, _q, vec_id, score): the k best of each block for each query, by the index (within the radius) or without."""
    rows = rows.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_m"))  # a row repeated any number of times is one with a count
    n, m = rows.count(), asked.count()
    parts, asks = max(1, -(-n // rows_block)), max(1, -(-m // queries_block))
    deal = lambda *c, into: F.pmod(F.xxhash64(*c), F.lit(into)).cast("int")
    each = lambda into: F.explode(F.sequence(F.lit(0), F.lit(into - 1)))
    left = rows.select(deal("_k", "_v", into=parts).alias("_p"), each(asks).alias("_a"), "_m", F.lit(False).alias("_asks"), "_k", "_v")
    right = asked.select(each(parts).alias("_p"), deal("_q", into=asks).alias("_a"), F.col("_q").alias("_m"), F.lit(True).alias("_asks"), "_k", "_v")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "_q": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        for size, part in pdf.groupby(pdf["_v"].map(len)):
            asks = part["_asks"].to_numpy()
            if asks.all() or not asks.any():
                continue
            x, ids, many = np.stack(part["_v"].to_numpy()[~asks]), part["_k"].to_numpy()[~asks], np.minimum(part["_m"].to_numpy()[~asks], k)
            q, q_ids, q_of = np.stack(part["_v"].to_numpy()[asks]), part["_k"].to_numpy()[asks], part["_m"].to_numpy()[asks]
            index = Index(model.value.codes(x)) if indexed and size == model.value.dim else None
            codes = model.value.codes(q) if index else q
            for v, i, h, c in zip(q, q_ids, q_of, codes, strict=True):
                at = index.within(c, model.value.radius)[0] if index else np.arange(len(x))
                at = at[ids[at] != i]
                at = np.repeat(at, many[at])
                score = (x[at] * v).sum(axis=1)
                first = best(ids[at], score, k)
                out.append(pd.DataFrame({"query_id": i, "_q": h, "vec_id": ids[at][first], "score": score[first]}))
        return pd.concat(out, ignore_index=True)

    return left.union(right).groupBy("_p", "_a").applyInPandas(block, "query_id long, _q long, vec_id long, score double")
