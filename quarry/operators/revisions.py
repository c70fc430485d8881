"""A corpus at several revisions, as a table (revision, path, content): listings, changed paths, snapshots of a symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import corpus as C


def listing(corpus: DataFrame, revision: str, suffixes: Sequence[str], refuse: bool = False) -> DataFrame:
    """(path, content) at a revision. Paths that are not valid drop out, or are an error."""
    files = corpus.where(F.col("revision") == revision)
    ok = T.valid_path(F.col("path"), tuple(suffixes))
    if refuse:
        checked = F.when(ok, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("path refused: "), F.col("path"))))
        return files.select(checked.cast("string").alias("path"), "content")
    return files.where(ok).select("path", "content")


def changed_paths(corpus: DataFrame, base: str, head: str) -> DataFrame:
    """(path, status) of what a revision adds, deletes or modifies."""
    at = lambda r: corpus.where(F.col("revision") == r).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    status = F.when(F.col("status") == "new", "added").when(F.col("status") == "changed", "modified").otherwise(F.col("status"))
    return C.changes(corpus.where(F.col("revision") == head), at(base)).where("status <> 'unchanged'").select("path", status.alias("status"))


def in_changed(summaries: DataFrame, changed: DataFrame) -> DataFrame:
    """The summaries (path, ...) of changed paths."""
    return summaries.join(changed.select("path").distinct(), "path", "left_semi")


def definitions(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, path, line, content): the lines (path, line, content) that hold a symbol and define it."""
    hit = F.contains("content", F.col("symbol")) & T.defines(F.col("path"), F.col("content"), F.col("symbol"))
    return lines.join(F.broadcast(symbols.select("symbol").distinct()), hit).select("symbol", "path", "line", "content")


def snapshots(lines: DataFrame, symbol: str, context: int = 20, most_definitions: int = 10, most_occurrences: int = 50, sections: int = 3) -> DataFrame:
    """(revision, kind, path, line): by revision the first definitions and occurrences of a symbol, and the lines around the
    first ``sections`` definitions. lines: (revision, path, line, content)."""
    hits = lines.where(F.contains("content", F.lit(symbol))).withColumn("_d", T.defines(F.col("path"), F.col("content"), F.lit(symbol)))
    order = W.partitionBy("revision").orderBy("path", "line")
    ranked = lambda df: df.withColumn("_n", F.row_number().over(order))
    found = ranked(hits.where("_d")).where(F.col("_n") <= most_definitions)
    where = found.where(F.col("_n") <= sections).select("revision", "path", F.explode(F.sequence(F.col("line") - context, F.col("line") + context)).alias("line"))
    row = lambda df, kind: df.select("revision", F.lit(kind).alias("kind"), "path", "line")
    around = lines.join(F.broadcast(where.distinct()), ["revision", "path", "line"], "left_semi")
    return row(found, "definition").union(row(ranked(hits).where(F.col("_n") <= most_occurrences), "occurrence")).union(row(around, "section"))
