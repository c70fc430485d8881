"""Change detection over a stream of file snapshots: each micro-batch is compared with the index and written as its next version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import corpus as C
from quarry.sources import files as S


def follow(stream: DataFrame, folder: str, checkpoint: str, on_changes: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand new and changed files (path, status) of each batch of (path, content) on; a batch that is run again gives the same version."""

    def batch(rows: DataFrame, n: int) -> None:
        rows = C.first_of(rows, ["path"], [F.sha2(F.col("content").cast("binary"), 256)])
        was = S.load_index(rows.sparkSession, folder, n)
        on_changes(C.changes(rows, was).where("status in ('new', 'changed')"), n)
        now = rows.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
        S.save_index(now.union(was.join(now, "path", "left_anti")), folder, n + 1)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
