"""Helpers shared by the corpus operators: tables, lineage cuts, ranks without a global sort, components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A table that a query plans on the driver is broadcast only up to this many rows; beyond it Spark chooses the join.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Where that setting is absent, a temporary folder is used on one machine; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset and all runs on one machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return at or os.path.join(tempfile.gettempdir(), "quarry-checkpoints")


def through_parquet(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again; the order of rows may be another."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a driver-planned table of a known number of rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Rows of a range in which rows are numbered one by one.
RANGE_ROWS = 50_000


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with names that no operator uses, and the new name of each of its columns."""
    names = {c: f"__own_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


#: Rows of one key that may meet in one task.
HOT_ROWS = 100_000


def join_hot(rows: DataFrame, unique: DataFrame, on: list[str], weight: str, total: int, most: int = HOT_ROWS) -> DataFrame:
    """rows joined with ``unique``, which has one row a key and tells in ``weight`` how many of the ``total`` rows have it.

    Keys of over ``most`` rows are broadcast, so that their rows need not meet in one task; there are fewer of them than
    total / most, and ``most`` is raised so that this is at most ``BROADCAST_ROWS``. The result is the join's either way.
    """
    if total <= most:
        return rows.join(unique, on)
    hot = unique.where(F.col(weight) > max(most, total // BROADCAST_ROWS))
    if hot.isEmpty():
        return rows.join(unique, on)
    hot = F.broadcast(cut(hot))
    rest = rows.join(hot.select(*on), on, "left_anti").join(unique, on)
    return rest.unionByName(rows.join(hot, on))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_key(col: str) -> Column:
    """A never-null key: null is a group of its own, apart from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("0"))


def rank_in_groups(df: DataFrame, group: str, key: str, ties: list[str], out: str, rows: int) -> DataFrame:
    """1-based rank of each row in ``group`` by the lower-case hex string ``key``, then by ``ties``.

    A group is cut into ranges of its key by the first hex digits, as many as make ranges of ``RANGE_ROWS`` at most of
    ``rows`` rows in a group. Row numbers are taken inside a range and shifted by the sizes of the ranges before it, so
    that a group with a third of all rows is dealt to many tasks.
    """
    hex_digits = 2
    while rows > RANGE_ROWS * 16**hex_digits:
        hex_digits += 1
    df = df.withColumn("_b", F.substring(key, 1, hex_digits))
    sizes = df.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inside = W.partitionBy(group, "_b").orderBy(key, *ties)
    return df.join(shift, [group, "_b"]).withColumn(out, F.row_number().over(inside) + F.col("_s")).drop("_b", "_s")


def components(edges: DataFrame, max_rounds: int = 40, hub: int = HOT_ROWS) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) longs; component is the smallest node reachable.

    Alternating star contraction: every round points the larger neighbours of a node at its smallest neighbour, then its
    smaller ones, until each node hangs on its component's minimum. Each round is grouped minima joined back by key and
    is written to the checkpoint folder; only a count and a checksum come to the driver. Minima of hubs, nodes of over
    ``hub`` neighbours, are broadcast, so that a hub's neighbours need not meet in one task; where ``BROADCAST_ROWS``
    hubs could be, the bound is raised so that there are fewer. Nulls and loops are ignored.
    """
    cur = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    cur = cut(cur.distinct())
    seen = cur.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    for _ in range(max_rounds):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
        low = low.select("u", F.least("u", "m").alias("m"), "d")
        up = both.where("v > u")
        most = max(hub, 2 * seen["n"] // BROADCAST_ROWS)
        # A node has no more neighbours than there are edges: below that none is a hub.
        hubs = cut(low.where(F.col("d") > most).select("u", "m")) if seen["n"] > most else None
        if hubs is None or hubs.isEmpty():
            large = up.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            up = up.join(F.broadcast(hubs.toDF("u", "h")), "u", "left")
            large = up.where("h is null").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            large = large.union(up.where("h is not null").select("v", "h"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        cur = cut(hung.select(F.greatest("b", F.col("m")).alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", "m")).distinct())
        now = cur.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled: every node other than a minimum has exactly one edge, to its minimum.
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
