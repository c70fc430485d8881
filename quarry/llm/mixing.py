"""Mixing sources to target weights by Pfair scheduling of source blocks.

A source's rows are shuffled by a seed and cut into blocks. In a period of W slots a source of integer weight w gets w
blocks; its j-th block (from 0) is released at slot floor(j*W/w) and is due by slot ceil((j+1)*W/w). Earliest deadline
first over these unit jobs meets every deadline, because the weights add up to W, and so after any number of slots a
source is less than one block from its share of W. When a source runs out, the others go on with their own weights.
Target weights are taken in units of one ``resolution``-th; the units stand in the column ``weight``.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_ROWS, RESOLUTION, MAX_SOURCES = 32, 2000, 2000
ADDED = ("weight", "block", "slot", "offset")


def integer_weights(shares: Mapping[str, float], resolution: int) -> dict[str, int]:
    """Shares in units of ``1 / resolution``, by largest remainders; one unit at least for each source."""
    if len(shares) > resolution:
        raise ValueError(f"{len(shares)} sources, more than {resolution} units of weight")
    total = sum(shares.values())
    exact = {s: resolution * v / total for s, v in shares.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    while (short := resolution - sum(out.values())) != 0:
        step = 1 if short > 0 else -1
        able = [s for s in out if step > 0 or out[s] > 1]
        for s in sorted(able, key=lambda s: (step * (out[s] - exact[s]), s))[: abs(short)]:
            out[s] += step
    return out


def period(weights: Mapping[str, int]) -> list[tuple[str, int]]:
    """(source, index of its block) for each slot of one period, by earliest deadline first."""
    w = sum(weights.values())
    release: list[list[tuple[int, str, int]]] = [[] for _ in range(w)]
    for s, a in weights.items():
        for j in range(a):
            release[j * w // a].append((-(-(j + 1) * w // a), s, j))
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(w):
        for job in release[t]:
            heapq.heappush(ready, job)
        due, s, j = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("missed deadline")
        out.append((s, j))
    return out


def plan(blocks: Mapping[str, int], weights: Mapping[str, int]) -> tuple[list[tuple], list[tuple]]:
    """Phases (source, phase, first, last, per_period, slots_per_period, base) and slots (phase, source, j, slot).

    A phase repeats one period while every source in it has blocks for it. Before a source runs out, one period takes
    the rest of it as its weight. Sizes depend on sources and resolution only, never on rows.
    """
    left, used = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    phases, slots, base, k = [], [], 0, 0
    while left:
        w = {s: weights[s] for s in left}
        times = min(left[s] // w[s] for s in left)
        if not times:
            w, times = {s: min(a, left[s]) for s, a in w.items()}, 1
        size = sum(w.values())
        for s, a in w.items():
            phases.append((s, k, used[s], used[s] + a * times - 1, a, size, base))
            used[s] += a * times
            left[s] -= a * times
        slots += [(k, s, j, t) for t, (s, j) in enumerate(period(w))]
        base += size * times
        left = {s: n for s, n in left.items() if n}
        k += 1
    return phases, slots


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, *, source: str = "source", key: str = "doc_id", text: str = "text",
    block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION, seed: int = 42, max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """Add weight, block, slot and offset to every row; (slot, offset) is the mixed order.

    weights: target share by source name; without it, shares follow the square root of the number of rows. Sources
    without a weight get the smallest weight given. Every row is kept once. A null source is a source of its own, called
    null in ``weights`` by None. Repeated rows are rows like others; rows alike in key and text may swap places, which
    can't be seen. Texts may have any length. An empty table gives an empty result. Only the count of rows by source comes
    to the driver, for at most ``max_sources`` sources; more raise ValueError. Added columns replace columns of the same
    name; others may have any names.
    """
    spark = docs.sparkSession
    rows, own = common.shielded(docs)
    rows = rows.withColumns({
        "_g": common.group_key(own[source]),
        "_k": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(own[key]).cast("string"), F.lit("null")))),
        "_t": F.md5(F.coalesce(F.col(own[text]).cast("string"), F.lit(""))),
    })
    counts = {r["_g"]: r["n"] for r in rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    blocks = {s: -(-n // block_rows) for s, n in sorted(counts.items())}
    if weights is None:
        shares = {s: n**0.5 for s, n in counts.items()}
    else:
        named = {"0" if s is None else f"={s}": float(v) for s, v in weights.items()}
        if any(v <= 0 for v in named.values()) or not named:
            raise ValueError("weights must be positive")
        shares = {s: named.get(s, min(named.values())) for s in counts}
    units = integer_weights(dict(sorted(shares.items())), resolution) if shares else {}
    phases, slots = plan(blocks, units)
    p = spark.createDataFrame([(*x, units[x[0]]) for x in phases], "_g string, _p int, _first long, _last long, _a long, _w long, _base long, weight long")
    s = spark.createDataFrame(slots, "_p int, _g string, _j long, _slot long")
    ranked = common.rank_in_groups(rows, "_g", "_k", [own[key], "_t"], "_r", max(counts.values(), default=0))
    ranked = ranked.withColumns({"block": F.floor((F.col("_r") - 1) / block_rows).cast("long"), "offset": ((F.col("_r") - 1) % block_rows).cast("int")})
    placed = ranked.join(common.small(p, len(phases)).withColumnRenamed("_g", "_pg"), (F.col("_g") == F.col("_pg")) & F.col("block").between(F.col("_first"), F.col("_last"))).drop("_pg")
    placed = placed.withColumn("_j", (F.col("block") - F.col("_first")) % F.col("_a"))
    placed = placed.join(common.small(s, len(slots)), ["_p", "_g", "_j"])
    turn = F.floor((F.col("block") - F.col("_first")) / F.col("_a")).cast("long")
    return placed.withColumn("slot", F.col("_base") + turn * F.col("_w") + F.col("_slot")).select(
        *[F.col(n).alias(c) for c, n in own.items() if c not in ADDED], *ADDED
    )


def in_order(docs: DataFrame, weights: Mapping[str, float] | None = None, *, place: tuple[str, str] | None = None, **options) -> DataFrame:
    """The rows of docs with their own columns, sorted into the mixed order.

    A reader need not keep the order of files; ``place`` names two columns to add for slot and offset, which hold it and
    replace columns of these names.
    """
    away = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c in ADDED}
    out = mix(docs.withColumnsRenamed(away), weights, **options).orderBy("slot", "offset")
    placed = [F.col(c).alias(n) for c, n in zip(("slot", "offset"), place or (), strict=False)]
    return out.select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns if c not in (place or ())], *placed)
