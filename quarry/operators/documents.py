"""Documentation of files in parts: merging, statistics, plans of shards, their bundles and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = ("purpose", "data_flow", "algorithm_flow")
LISTS = ("main_components", "important_variables", "external_dependencies", "side_effects", "risks_or_notes")


def _joined(values: Column) -> Column:
    """Texts in order, a line each; one that the text so far holds adds nothing."""
    add = lambda sofar, x: F.when(F.contains(sofar, x), sofar).when(sofar == "", x).otherwise(F.concat(sofar, F.lit("\n"), x))
    return F.aggregate(values, F.lit(""), add)


def merge(pieces: DataFrame, texts: Sequence[str] = TEXTS, lists: Sequence[str] = LISTS) -> DataFrame:
    """One document a path of pieces (path, ord, texts and lists): texts joined in order of ord, lists without repeats in
    the order in which they first come.

    Of equal texts and items of a path only the first goes on, so that a path's repeats are gone before they meet.
    """
    out = pieces.select("path").distinct()
    for c in texts:
        first = pieces.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy("path", c).agg(F.min("ord").alias("ord"))
        whole = first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))).alias("_v"))
        out = out.join(whole.select("path", _joined(F.transform("_v", lambda x: x["v"])).alias(c)), "path", "left").withColumn(c, F.coalesce(c, F.lit("")))
    for c in lists:
        items = pieces.select("path", "ord", F.posexplode(c).alias("p", "v"))
        first = items.groupBy("path", "v").agg(F.min(F.struct("ord", "p")).alias("o"))
        whole = first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias(c))
        kind = pieces.schema[c].dataType.simpleString()
        out = out.join(whole, "path", "left").withColumn(c, F.coalesce(c, F.array().cast(kind)))
    return out


def shard_problems(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(shard_id, problem): several results, none, or one that is not expected."""
    n = results.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    both = n.join(expected.select("shard_id").distinct().withColumn("_e", F.lit(True)), "shard_id", "full_outer")
    problem = F.when(F.col("_e").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select("shard_id", problem.alias("problem")).where("problem is not null")


def refuse(problems: DataFrame) -> None:
    """Raise ValueError where there is a problem; the first ones are named."""
    some = problems.limit(5).collect()
    if some:
        raise ValueError(f"shards refused: {[tuple(r) for r in some]}")


def failures(results: DataFrame) -> DataFrame:
    """(shard_id, unit_id, reason) of all failed units (failed_units: array of these), in this order."""
    return results.select("shard_id", F.explode("failed_units").alias("f")).select("shard_id", "f.unit_id", "f.reason").orderBy("shard_id", "unit_id", "reason")


def merge_results(results: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, failures and one row of statistics of all shards' results; every expected shard has exactly one.

    results: shard_id, processed_units, failed_units, files (array of documents with path). Shards come in order of name.
    """
    refuse(shard_problems(results, expected))
    pieces = results.select("shard_id", F.posexplode("files").alias("p", "f")).where("coalesce(f.path, '') <> ''")
    files = merge(pieces.select(F.struct("shard_id", "p").alias("ord"), "f.*"))
    stats = results.agg(F.count(F.lit(1)).alias("shard_count"), F.coalesce(F.sum("processed_units"), F.lit(0)).alias("processed_units"), F.coalesce(F.sum(F.size("failed_units")), F.lit(0)).alias("failed_units"))
    return files, failures(results), stats.crossJoin(files.agg(F.count(F.lit(1)).alias("documented_files")))


def statistics(status: DataFrame, most: int | None = None) -> DataFrame:
    """One row of a run's figures from (path, status) of all files: new, changed, unchanged or deleted. At most ``most``
    files are selected, after it is known which have changed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    due = n("new", "changed")
    selected = F.least(due, F.lit(most)) if most is not None else due
    return status.agg(
        n("new", "changed", "unchanged").alias("repository_files"), due.alias("detected_changed_or_new_files"), selected.alias("changed_or_new_files"),
        (due - selected).alias("skipped_by_limit"), n("unchanged").alias("unchanged_files"), n("deleted").alias("deleted_files"),
    )


def selected(status: DataFrame, most: int | None = None) -> DataFrame:
    """The first new or changed paths, in order."""
    due = status.where("status in ('new', 'changed')").select("path").orderBy("path")
    return due.limit(most) if most is not None else due


def known_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents of source items (path, ...), with the items' columns; others drop out."""
    return documents.join(items, "path")


def manifest(units: DataFrame) -> DataFrame:
    """One row a shard of assigned units (shard_id, unit_id, lines, chars, risk), with its file and its units as text order has them."""
    total = lambda c, n: F.sum(c).cast("long").alias(n)
    out = units.groupBy("shard_id").agg(F.array_sort(F.collect_list("unit_id")).alias("unit_ids"), F.count(F.lit(1)).alias("unit_count"), total("lines", "total_lines"), total("chars", "total_chars"), total("risk", "total_risk_score"))
    return out.withColumn("payload_file", F.concat(F.lit("shards/"), "shard_id", F.lit(".json")))


def manifest_json(shards: DataFrame) -> DataFrame:
    """One row with the manifest as JSON: the few shards of a plan, in order of name."""
    row = F.struct("shard_id", "payload_file", "unit_ids", "unit_count", "total_lines", "total_chars", "total_risk_score")
    listed = shards.agg(F.array_sort(F.collect_list(row)).alias("shards"), F.sum("unit_count").alias("unit_count"), F.count(F.lit(1)).alias("shard_count"))
    matrix = F.struct(F.transform("shards", lambda s: F.struct(s["shard_id"].alias("shard_id"), s["payload_file"].alias("payload_file"))).alias("include"))
    return listed.select(F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "unit_count", "shard_count", matrix.alias("matrix"), "shards")).alias("manifest"))


def stale_units(planned: DataFrame, current: DataFrame) -> DataFrame:
    """(unit_id, problem): units of a plan that are no longer, and units that it does not have. Ids that follow from the
    content find changes that keep the number of units."""
    both = planned.select("unit_id").distinct().withColumn("_p", F.lit(True)).join(current.select("unit_id").distinct().withColumn("_c", F.lit(True)), "unit_id", "full_outer")
    return both.select("unit_id", F.when(F.col("_c").isNull(), "gone").when(F.col("_p").isNull(), "new").alias("problem")).where("problem is not null")


def write_bundle(units: DataFrame, payloads: DataFrame, folder: str) -> None:
    """Payloads (shard_id, unit_id, ...) as JSON in a folder for each shard, and then the manifest, which makes the bundle whole."""
    payloads.repartition("shard_id").write.partitionBy("shard_id").mode("overwrite").json(f"{folder}/shards")
    manifest_json(manifest(units)).coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


MANIFEST = "unit_count long, shard_count long, shards array<struct<shard_id string, payload_file string, unit_ids array<string>, unit_count long>>"


def read_bundle(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The payloads of a bundle; an error where they are not the units that the manifest names, each once."""
    listed = spark.read.text(f"{folder}/manifest").select(F.from_json("value", MANIFEST).alias("m"))
    named = listed.select(F.explode("m.shards").alias("s")).select("s.shard_id", F.explode("s.unit_ids").alias("unit_id"))
    payloads = spark.read.schema(f"shard_id string, {schema}").json(f"{folder}/shards")
    got = payloads.groupBy("shard_id", "unit_id").agg(F.count(F.lit(1)).alias("n"))
    both = got.join(named.withColumn("_e", F.lit(True)), ["shard_id", "unit_id"], "full_outer")
    refuse(both.where("n is null or n > 1 or _e is null").select("shard_id", "unit_id"))
    return payloads
