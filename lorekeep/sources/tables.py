"""Tables of the test data, and the views of them that stand for a source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: file_id, path, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def lines(files_df: DataFrame, *keep: str) -> DataFrame:
    """One row per line, numbered from 1."""
    return files_df.select(*(keep or ("file_id",)), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line_no", (F.col("pos") + 1).cast("bigint")).drop("pos")


#: The same files for DuckDB.
FILES_SQL = "files AS (SELECT doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents)"
LINES_SQL = "lines AS (SELECT file_id, path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM files)"
