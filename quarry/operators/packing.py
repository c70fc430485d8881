"""Order-dependent packing: batches, units, shards, chunks with long lines. A group's rows are planned in one place by design."""

from __future__ import annotations

import os
import tempfile
from array import array
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder of ``spark.checkpoint.dir``; where it is unset a temporary one on one machine, and an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = sc.getConf().get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(at or os.path.join(tempfile.gettempdir(), "quarry-checkpoints"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, mb: int = 32, most: int = 4096) -> DataFrame:
    """df by its keys, in a task for each ``mb`` of its estimated size: no fewer than Spark's own number, so that a task's share
    does not grow with the input. ``most`` holds where Spark has no estimate."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, min(most, -(-size // (mb << 20))))
    return df.repartition(n, *keys)


def unit_ids(units: DataFrame, risk: str, arrival: str, prefix: str = "full-scan-unit-") -> DataFrame:
    """units with unit_id: numbered from 1 by falling risk, and by arrival among equals.

    Rows are sorted by ranges; a row's number is its place in its range and the rows of the ranges before, so that they
    never meet in one task.
    """
    rows = cut(units.orderBy(F.desc(risk), arrival).withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumn("_r", F.shiftright("_m", 33))
    before = W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("_r").agg(F.count(F.lit(1)).alias("_c")).select("_r", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    n = F.col("_m") - F.shiftleft(F.col("_r"), 33) + F.col("_s") + 1
    return rows.join(F.broadcast(sizes), "_r").withColumn("unit_id", F.concat(F.lit(prefix), n.cast("string"))).drop("_m", "_r", "_s")


class NextFit:
    """Batch number (from 1) of each file in order: a batch is closed by the first file that does not fit."""

    def __init__(self, most_files: int = 5, most_lines: int = 1200):
        self.most_files, self.most_lines = most_files, most_lines
        self.batch, self.held, self.n = 1, 0, 0

    def add(self, lines: int) -> int:
        if self.n and (self.n >= self.most_files or self.held + lines > self.most_lines):
            self.batch, self.held, self.n = self.batch + 1, 0, 0
        self.held, self.n = self.held + lines, self.n + 1
        return self.batch


class FirstFit:
    """Unit number (from 0) of each file in order: the first unit with room.

    A tree over the units holds the most room for lines and for characters below each node (-1 where no file may come), so
    that the first unit with room is found without looking at each one before it.
    """

    def __init__(self, most_files: int = 8, most_lines: int = 900, most_chars: int = 45_000):
        self.most = (most_files, most_lines, most_chars)
        self.n, self.width = 0, 1
        self.files, self.lines, self.chars = array("l", [0]), array("l", [-1, -1]), array("l", [-1, -1])

    def _widen(self) -> None:
        old, self.width = self.width, 2 * self.width
        self.files.extend([0] * old)
        for name in ("lines", "chars"):
            was, now = getattr(self, name), array("l", [-1]) * (2 * self.width)
            at = 1
            while at <= old:  # a level of the old tree is the left half of one of the new tree
                now[2 * at : 3 * at] = was[at : 2 * at]
                at *= 2
            now[1] = was[1]
            setattr(self, name, now)

    def _find(self, lines: int, chars: int) -> int:
        """The first unit with room, or the number of units."""
        at, left, right, width = 1, self.lines, self.chars, self.width
        while True:
            if left[at] >= lines and right[at] >= chars:
                if at >= width:
                    return at - width
                at *= 2
            else:
                while at & 1:  # behind a right child its parent's right neighbour is next
                    at >>= 1
                if not at:
                    return self.n
                at += 1

    def add(self, lines: int, chars: int) -> int:
        most_files, most_lines, most_chars = self.most
        unit = self._find(lines, chars)
        if unit == self.n:
            self.n += 1
            if self.n > self.width:
                self._widen()
            room = (most_lines - lines, most_chars - chars)
        else:
            room = (self.lines[self.width + unit] - lines, self.chars[self.width + unit] - chars)
        self.files[unit] += 1
        at = self.width + unit
        self.lines[at], self.chars[at] = (-1, -1) if self.files[unit] >= most_files or min(room) < 0 else room
        at >>= 1
        while at:
            a, b = max(self.lines[2 * at], self.lines[2 * at + 1]), max(self.chars[2 * at], self.chars[2 * at + 1])
            if self.lines[at] == a and self.chars[at] == b:
                break
            self.lines[at], self.chars[at] = a, b
            at >>= 1
        return unit


def next_fit(rows: list[tuple[str, int]], most_files: int = 5, most_lines: int = 1200) -> list[int]:
    """Batch number (from 1) of each (name, lines) in order."""
    plan = NextFit(most_files, most_lines)
    return [plan.add(lines) for _, lines in rows]


def first_fit(sizes: list[tuple[int, int]], most_files: int = 8, most_lines: int = 900, most_chars: int = 45_000) -> list[int]:
    """Unit number (from 0) of each (lines, chars) in order."""
    plan = FirstFit(most_files, most_lines, most_chars)
    return [plan.add(*s) for s in sizes]


def _planned(files: DataFrame, group: str, sizes: Sequence[str], plan: Callable[[], NextFit | FirstFit], kept: Sequence[str], name: str) -> DataFrame:
    """(group, path, kept, name): the number that ``plan`` gives each file of a group by its sizes, in order of path.

    A group's rows pass through one task as Spark has sorted them; only the plan is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, add = (), None
        for b in batches:
            out = []
            for g, *x in zip(b.column(0).to_pylist(), *(b.column(k + 2).to_pylist() for k in range(len(sizes))), strict=True):
                if add is None or g != now:
                    now, add = g, plan().add
                out.append(add(*x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(b.column(2 + sizes.index(k)) for k in kept), pa.array(out, pa.int32())], [group, "path", *kept, name])

    rows = files.select(group, "path", *sizes).repartition(group).sortWithinPartitions(group, "path")
    return rows.mapInArrow(run, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in (group, "path", *kept)) + f", `{name}` int")


def batches(files: DataFrame, group: str, most_files: int = 5, most_lines: int = 1200) -> DataFrame:
    """Next-fit batches within a group, in order of path: (group, path, n_lines, batch)."""
    return _planned(files, group, ["n_lines"], lambda: NextFit(most_files, most_lines), ["n_lines"], "batch")


def small_units(files: DataFrame, language: str = "language") -> DataFrame:
    """First-fit units of small files of one language, in order of path: (language, path, unit)."""
    return _planned(files, language, ["n_lines", "n_chars"], FirstFit, [], "unit")


def balance(units: list[tuple[str, int, int, int]], n_shards: int, lines: int = 6000, chars: int = 300_000, per: int = 24) -> dict[str, int]:
    """Shard (from 0) of each (id, lines, chars, risk): large ones first, each to the shard that is least full with it.

    Fullness is the largest of the three shares of the targets; ties go by lines, characters, units, risk and number.
    """
    load = [[0, 0, 0, 0] for _ in range(n_shards)]
    out = {}
    for name, a, b, r in sorted(units, key=lambda u: (-max(0, u[1]), -max(0, u[2]), -max(0, u[3]), u[0])):
        add = (max(0, a), max(0, b), 1, max(0, r))

        def full(k: int, add=add) -> tuple:
            x = [p + q for p, q in zip(load[k], add, strict=True)]
            shares = (x[0] / lines, x[1] / chars, x[2] / per)
            return (max(shares), *shares, x[3], k)

        k = min(range(n_shards), key=full)
        load[k] = [p + q for p, q in zip(load[k], add, strict=True)]
        out[name] = k
    return out


def shards(units: DataFrame, n_shards: int) -> DataFrame:
    """(shard_id, unit_ids, total_lines, total_chars, total_risk) for a plan of units (unit_id, n_lines, n_chars, risk).

    The assignment is a sequence by nature, over one row a unit of many files; ids sort as text.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = balance(list(zip(rows["unit_id"], rows["n_lines"], rows["n_chars"], rows["risk"], strict=True)), n_shards)
        rows = rows.assign(shard_id=[f"docs-shard-{at[u] + 1:03d}" for u in rows["unit_id"]])
        got = rows.groupby("shard_id").agg(unit_ids=("unit_id", lambda s: sorted(s)), total_lines=("n_lines", "sum"), total_chars=("n_chars", "sum"), total_risk=("risk", "sum"))
        return got.reset_index()

    one = units.select("unit_id", "n_lines", "n_chars", "risk").groupBy(F.lit(1).alias("_one"))
    return one.applyInPandas(lambda rows: run(rows), "shard_id string, unit_ids array<string>, total_lines long, total_chars long, total_risk long")


def slices(lines: list[str], most_lines: int = 750, most_chars: int = 35_000, overlap: int = 25) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of overlapping chunks within both caps; a line over the cap is cut into pieces of its own.

    A line counts with its line end. A file without lines is one empty chunk.
    """
    if not lines:
        return [(1, 1, "")]
    out, start, size = [], 0, 0
    for i, line in enumerate(lines):
        if len(line) > most_chars:
            if i > start:
                out.append((start + 1, i, "\n".join(lines[start:i])))
            out += [(i + 1, i + 1, line[k : k + most_chars]) for k in range(0, len(line), most_chars)]
            start, size = i + 1, 0
            continue
        if i > start and (i - start >= most_lines or size + len(line) + 1 > most_chars):
            out.append((start + 1, i, "\n".join(lines[start:i])))
            start = max(start, i - overlap)
            size = sum(len(x) + 1 for x in lines[start:i])
        size += len(line) + 1
    if start < len(lines):
        out.append((start + 1, len(lines), "\n".join(lines[start:])))
    return out


def chunked(files: DataFrame, **caps: int) -> DataFrame:
    """(path, part, start_line, end_line, chunk) of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, k, *s) for p, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, s in enumerate(slices((t or "").splitlines(), **caps), 1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()], strict=True)], ["path", "part", "start_line", "end_line", "chunk"])

    return files.select("path", "content").mapInArrow(run, "path string, part int, start_line int, end_line int, chunk string")


def queries(corpus: Callable[[SparkSession, str], DataFrame]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarry.operators import corpus as C

    def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.plan_facts(corpus(spark, sf_dir)).withColumn("language", T.suffix(F.col("path")))

    def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = facts(spark, sf_dir)
        n = C.shard_count(f).first()["n_shards"]
        return shards(f.withColumnRenamed("path", "unit_id"), n)

    return {
        "ref_batches": lambda s, d: batches(facts(s, d), "language"),
        "ref_small_units": lambda s, d: small_units(facts(s, d).where("size_class = 'small'")),
        "ref_shards": shard_plan,
        "ref_slices": lambda s, d: chunked(corpus(s, d), most_lines=40, most_chars=3000, overlap=5),
    }
