"""Source trees and JSON records as DataFrames, and the index as versioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarry.functions import text as T


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all supported files below root outside skipped folders; content is null where it is not UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), "^[a-z]+:/*|/+$", "")
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), F.concat(F.lit("^/*\\Q"), F.regexp_replace(base, "^/+", ""), F.lit("\\E/+")), "")
    out = files.select(inside.alias("path"), F.expr("try_validate_utf8(cast(content as string))").alias("content"))
    return out.where(T.supported(F.col("path")) & ~T.skipped(F.col("path")))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records below a folder with a declared schema; malformed ones drop out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").json(path)


def save_index(index: DataFrame, folder: str, version: int) -> None:
    """A new version beside the earlier ones, which stay."""
    index.write.mode("overwrite").parquet(f"{folder}/v{version:08d}")


def load_index(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The version, else the one before it, else an empty index."""
    for v in (version, version - 1):
        try:
            return spark.read.parquet(f"{folder}/v{v:08d}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    return spark.createDataFrame([], "path string, sha256 string")
