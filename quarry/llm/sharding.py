"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seed within their source and ranked; row r of n gets the fractional rank (2r-1)/(2n). All rows
sorted by it are cut into shards of equal count (law ``rows``), so that each shard holds every source in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Ranges of the fractional rank at least.
RANGES = 2048


def shard(docs: DataFrame, n_shards: int = 40, *, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = 42, ranges: int = RANGES) -> DataFrame:
    """Add shard (0 to n_shards-1) and slot (gapless from 0 within the shard) to every row.

    Shard sizes in rows differ by one at most. Ties in fractional rank go by source, null first; rows with the same key
    go by the md5 of their text, and rows alike in both may swap places. Null keys and texts are allowed. The order is
    found in two steps, each dealt by ranges of a hash or of the fractional rank, so that no source, however large,
    meets in one task; there are as many ranges as keep each small. Texts may have any length. An empty table gives an
    empty result. Columns shard and slot of the input are replaced; others may have any names.
    """
    rows, own = common.shielded(docs)
    n = docs.count()
    ranges = max(ranges, -(-n // common.RANGE_ROWS))
    rows = rows.withColumns({
        "_g": common.group_key(own[source]),
        "_k": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(own[key]).cast("string"), F.lit("null")))),
        "_t": F.md5(F.coalesce(F.col(own[text]).cast("string"), F.lit(""))),
    })
    totals = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    ranked = common.rank_in_groups(rows, "_g", "_k", [own[key], "_t"], "_r", n).join(totals, "_g")
    # The range is found with decimals, exactly; inside it the order goes by the double nearest to (2r-1)/2n.
    up = 2 * F.col("_r") - 1
    ranked = ranked.withColumns({"_q": F.floor(up.cast("decimal(20,0)") * ranges / (2 * F.col("_n")).cast("decimal(20,0)")).cast("int"), "_f": up / (2 * F.col("_n"))})
    sizes = ranked.groupBy("_q").agg(F.count(F.lit(1)).alias("_c"))
    shift = sizes.select("_q", F.coalesce(F.sum("_c").over(W.orderBy("_q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.sum("_c").over(W.partitionBy()).alias("_all"))
    order = W.partitionBy("_q").orderBy("_f", "_g", "_r")
    g = F.row_number().over(order) - 1 + F.col("_s")
    ranked = ranked.join(shift, "_q").withColumn("_i", g)
    out = ranked.withColumn("shard", F.expr(f"cast((_i * {n_shards}) div _all as int)"))
    out = out.withColumn("slot", F.expr(f"_i - (shard * _all + {n_shards - 1}) div {n_shards}"))
    return out.select(*[F.col(n).alias(c) for c, n in own.items() if c not in ("shard", "slot")], "shard", "slot")
