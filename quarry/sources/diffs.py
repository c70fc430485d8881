"""Unified diffs as rows, one a line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)")
SCHEMA = (
    "diff_id string, path string, source_file string, target_file string, change_type string, is_binary boolean, hunk int, section string, source_start int, source_length int, "
    "target_start int, target_length int, line int, kind string, source_line int, target_line int, content string, review_target boolean"
)
KINDS = {"+": "added", "-": "removed", " ": "context", "": "context", "\\": "metadata"}
NO_LINE = (None,) * 11 + (False,)


def _header_path(row: str) -> str:
    """The path of ``diff --git a/x b/x``; where both sides differ, what stands behind the last `` b/``."""
    both = row[len("diff --git ") :]
    half = len(both) // 2
    return both[half + 3 :] if both[2:half] == both[half + 3 :] and both[half : half + 3] == " b/" else both.rpartition(" b/")[2]


class _File:
    def __init__(self, path: str = "", source: str | None = None, target: str | None = None):
        self.path, self.source, self.target = path, source, target
        self.kind, self.binary, self.hunks, self.real = "modified", False, 0, bool(path)

    def head(self) -> tuple:
        kind = "binary" if self.binary else self.kind
        return self.path, self.source, self.target, kind, self.binary


def parse(diff: str, most: int | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA without the diff's id. A file without hunks (binary, or only renamed) has one row without a hunk.

    Beyond ``most`` lines in all, each hunk ends with one line of kind ``truncated``. A note such as the one on a missing
    last line end is a row of kind ``metadata``, also behind the last line that a hunk counts.
    """
    rows, at, seen = diff.split("\n"), 0, 0
    now = _File()

    def done() -> Iterator[tuple]:
        if now.real and not now.hunks:
            yield *now.head(), *NO_LINE

    while at < len(rows):
        row = rows[at]
        at += 1
        if row.startswith("diff --git "):
            yield from done()
            path = _header_path(row)
            now = _File(path, f"a/{path}", f"b/{path}")
        elif row.startswith("new file mode"):
            now.kind = "added"
        elif row.startswith("deleted file mode"):
            now.kind = "deleted"
        elif row.startswith("rename from "):
            now.kind, now.source = "renamed", "a/" + row[12:]
        elif row.startswith("rename to "):
            now.kind, now.path, now.target = "renamed", row[10:], "b/" + row[10:]
        elif row.startswith("Binary files "):
            now.binary = True
        elif row.startswith("--- ") and at < len(rows) and rows[at].startswith("+++ "):
            if now.hunks or not now.real:
                yield from done()
                now = _File()
            now.source, now.target, now.real = row[4:].split("\t")[0], rows[at][4:].split("\t")[0], True
            at += 1
            if now.source == "/dev/null":
                now.kind = "added"
            if now.target == "/dev/null":
                now.kind = "deleted"
            now.path = now.source.removeprefix("a/") if now.target == "/dev/null" else now.target.removeprefix("b/")
        elif m := HUNK.match(row):
            now.hunks += 1
            source, target, left, right = int(m[1]), int(m[3]), int(m[2] or 1), int(m[4] or 1)
            hunk = (*now.head(), now.hunks, m[5], source, left, target, right)
            n, cut = 0, False
            while at < len(rows) and (left > 0 or right > 0 or rows[at].startswith("\\")):
                line = rows[at]
                at += 1
                what = KINDS.get(line[:1], "context")
                places = (None if what in ("added", "metadata") else source, None if what in ("removed", "metadata") else target)
                source, left = source + (places[0] is not None), left - (places[0] is not None)
                target, right = target + (places[1] is not None), right - (places[1] is not None)
                n += 1
                if cut:
                    continue
                if most is not None and seen >= most:
                    cut = True
                    yield *hunk, n, "truncated", None, None, None, False
                    continue
                seen += 1
                yield *hunk, n, what, *places, line[1:], what in ("added", "removed")
    yield from done()


def parsed(batches: Iterator[pa.RecordBatch], most: int | None = None, held: int = 10_000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of SCHEMA for batches of (diff_id, diff), of no more than ``held`` rows or about as many ``chars`` of content.

    One diff at a time is text of Python.
    """
    names, types = zip(*(x.split() for x in SCHEMA.split(", ")), strict=True)
    kinds = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t] for t in types]
    at = names.index("content")
    rows: list[tuple] = []
    size = 0

    def full() -> pa.RecordBatch:
        nonlocal rows, size
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        rows, size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], list(names))

    for batch in batches:
        for k, d in zip(batch.column(0), batch.column(1), strict=True):
            key = k.as_py()
            for r in parse(d.as_py() or "", most):
                rows.append((key, *r))
                size += len(r[at - 1] or "")
                if len(rows) >= held or size >= chars:
                    yield full()
    if rows:
        yield full()


def diff_lines(diffs: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of all diffs (diff_id, diff); null diffs have none."""
    return diffs.select("diff_id", "diff").mapInArrow(lambda batches: parsed(batches, most), SCHEMA)


def diff_files(lines: DataFrame) -> DataFrame:
    """One row a file: added and deleted lines, lines that count for a review, and whether the diff was cut at the cap."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return lines.groupBy("diff_id", "path", "source_file", "target_file", "change_type", "is_binary").agg(
        n("added").alias("added_lines"), n("removed").alias("deleted_lines"), n("added", "removed", "context").alias("review_lines"),
        F.count_distinct("hunk").alias("n_hunks"), (n("truncated") > 0).alias("truncated"),
    )


def demo(spark: SparkSession) -> DataFrame:
    """A small diff to try things on."""
    text = "diff --git a/shop/cart.py b/shop/cart.py\n--- a/shop/cart.py\n+++ b/shop/cart.py\n@@ -45,2 +45,5 @@ class Cart:\n     def total(self):\n         items = self.items\n+        rate = self.rate\n+        if rate = 0:\n+            return None\n"
    return spark.createDataFrame([("demo", text)], "diff_id string, diff string")
