"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned so that their energy lies in the leading dimensions. Rows of a label are cut into bins along the
direction of largest spread, as wide as two linked vectors can be apart there, and large bins into chunks; only tiles of
equal or neighbouring bins are compared. A tile adds up leading dimensions first; the norms of what is left bound the
rest of each product, and pairs that cannot reach the threshold stop. What remains is decided on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .vectors import moments, usable

#: Rows of a chunk; a tile holds two chunks.
CHUNK = 2048
#: Dimensions added up before the bound is tested again.
STEP = 16
#: Lengths of vectors that a table may hold; each has its own comparison.
MAX_LENGTHS = 1000


def tile_links(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b whose cosine reaches the threshold."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    za, zb = a / na[:, None] @ turn, b / nb[:, None] @ turn
    dim = za.shape[1]
    steps = list(range(min(STEP, dim), dim, STEP)) + [dim]
    rest = lambda z, k: np.sqrt(np.maximum(0, (z[:, k:] ** 2).sum(axis=1)))
    low = threshold - 1e-9
    out_i, out_j = [], []
    for s in range(0, len(a), 256):
        part = za[s : s + 256]
        k = steps[0]
        got = part[:, :k] @ zb[:, :k].T
        i, j = np.nonzero(got + np.outer(rest(part, k), rest(zb, k)) >= low)
        if len(i) > got.size // 16:  # dense: the whole product is cheaper than pairs
            i, j = np.nonzero(part @ zb.T >= low)
        else:
            so_far = got[i, j]
            for k, m in zip(steps, steps[1:], strict=False):
                so_far = so_far + np.einsum("ij,ij->i", part[i, k:m], zb[j, k:m])
                keep = so_far + rest(part, m)[i] * rest(zb, m)[j] >= low
                i, j, so_far = i[keep], j[keep], so_far[keep]
        for x in range(0, len(i), 1 << 17):
            p, q = i[x : x + (1 << 17)] + s, j[x : x + (1 << 17)]
            exact = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q])
            out_i.append(p[exact >= threshold])
            out_j.append(q[exact >= threshold])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of 0..n-1 the smallest index reachable by the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, chunk: int = CHUNK
) -> DataFrame:
    """One row per row of vectors: key, n_links, component_id, kept.

    Rows link where labels are equal and not null and the cosine in doubles reaches the threshold (over 0, under 1).
    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, like rows with a null
    key or label and vectors of unequal length. Vectors equal in every component are one vector with a count, and so a
    copy made a million times costs no more than one. Repeated rows count as vectors of their own that link. A row that
    links with nothing has component_id = key; kept is false for a null key. An empty table gives an empty result. More
    than ``MAX_LENGTHS`` different lengths raise ValueError. Ties do not arise; other columns are left out.
    """
    x = vectors.select(F.col(key).alias("_k"), F.col(label).cast("string").alias("_l"), F.col(vector).cast("array<double>").alias("_v"))
    x = x.withColumn("_ok", usable("_v") & F.col("_k").isNotNull() & F.col("_l").isNotNull())
    x = x.withColumns({"_v": F.when(F.col("_ok"), F.col("_v")), "_d": F.when(F.col("_ok"), F.size("_v"))})
    groups = x.where("_ok").groupBy("_l", "_d", "_v").agg(F.min("_k").alias("_rep"), F.count(F.lit(1)).alias("_m"))
    groups = common.cut(groups)
    found = None
    dims = [r["_d"] for r in groups.select("_d").distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(dims) > MAX_LENGTHS:
        raise ValueError(f"more than {MAX_LENGTHS} lengths of vectors")
    for dim in dims:
        part = _compare(groups.where(F.col("_d") == dim), dim, threshold, chunk)
        found = part if found is None else found.union(part)
    alone = lambda rows: rows.select("_k", F.lit(0).cast("long").alias("n_links"), F.col("_k").alias("component_id"))
    if found is None:
        marked = alone(x)
    else:
        found = common.cut(found)
        near = found.groupBy("a").agg(F.sum("n").alias("_n"))
        component = common.components(found.where("b is not null").select("a", "b"))
        named = groups.join(near, F.col("_rep") == near["a"], "left").join(component, F.col("_rep") == component["node"], "left")
        named = named.select("_l", "_v", "_m", (F.col("_m") - 1 + F.coalesce("_n", F.lit(0))).alias("n_links"), F.coalesce("component", "_rep").alias("component_id"))
        total = groups.agg(F.sum("_m").alias("n")).first()["n"]
        linked = common.join_hot(x.where("_ok").select("_k", "_l", "_v"), named, ["_l", "_v"], "_m", total)
        marked = linked.select("_k", "n_links", "component_id").union(alone(x.where("not _ok")))
    return marked.select(F.col("_k").alias(key), "n_links", "component_id", F.coalesce(F.col("_k") == F.col("component_id"), F.lit(False)).alias("kept"))


def _compare(groups: DataFrame, dim: int, threshold: float, chunk: int) -> DataFrame:
    """(a, n, b): rows linked with a in a tile, and b, the smallest representative that a hangs on there or null."""
    spark = groups.sparkSession
    n, total, second = moments(groups.select("_v"), dim)
    turn = np.linalg.eigh(second)[1][:, ::-1].copy()
    spread = np.linalg.eigh(second / max(n, 1) - np.outer(total, total) / max(n, 1) ** 2)[1][:, -1]
    wide = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    axis = F.array(*[F.lit(float(v)) for v in spread])
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    binned = groups.withColumn("_b", F.floor(dot(F.col("_v"), axis) / F.sqrt(dot(F.col("_v"), F.col("_v"))) / wide).cast("int"))
    binned = binned.select("_l", "_b", "_rep", "_m", "_v")
    sizes = binned.groupBy("_l", "_b").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_s"))
    order = W.partitionBy("_l").orderBy("_b")
    beside = lambda f, d: F.when(f("_b").over(order) == F.col("_b") + d, f("_s").over(order)).otherwise(0)
    sizes = sizes.withColumns({"_next": beside(F.lead, 1), "_last": beside(F.lag, -1)})
    rows = binned.join(sizes, ["_l", "_b"]).withColumn("_c", F.pmod(F.xxhash64("_rep"), "_s").cast("int"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda b1, c1, b2, c2: F.struct(b1.alias("b1"), c1.alias("c1"), b2.alias("b2"), c2.alias("c2"))
    b, c = F.col("_b"), F.col("_c")
    tiles = F.concat(
        F.transform(upto("_s"), lambda o: tile(b, F.least(c, o), b, F.greatest(c, o))),
        F.transform(upto("_next"), lambda o: tile(b, c, b + 1, o)),
        F.transform(upto("_last"), lambda o: tile(b - 1, o, b, c)),
    )
    dealt = rows.select("_l", "_rep", "_m", "_v", "_b", "_c", F.explode(tiles).alias("_t"))
    dealt = dealt.select("_l", "_rep", "_m", "_v", ((F.col("_b") == F.col("_t.b1")) & (F.col("_c") == F.col("_t.c1"))).alias("_first"), "_t.*")
    turned = spark.sparkContext.broadcast(turn)

    def compare(tile: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rep")
        v, rep, many, first = np.stack(rows["_v"].to_numpy()), rows["_rep"].to_numpy(), rows["_m"].to_numpy(), rows["_first"].to_numpy()
        if tile[1:3] == tile[3:]:  # else a chunk may have come out empty
            i, j = tile_links(v, v, turned.value, threshold)
            i, j = i[i < j], j[i < j]
        else:
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            i, j = tile_links(v[left], v[right], turned.value, threshold)
            i, j = left[i], right[j]
        links = np.zeros(len(v), np.int64)
        np.add.at(links, i, many[j])
        np.add.at(links, j, many[i])
        at = np.flatnonzero(links)
        low = forest(len(v), i, j)[at]
        up = pd.array(rep[low], dtype="Int64")
        up[low == at] = pd.NA
        return pd.DataFrame({"a": rep[at], "n": links[at], "b": up})

    return dealt.groupBy("_l", "b1", "c1", "b2", "c2").applyInPandas(compare, "a long, n long, b long")
