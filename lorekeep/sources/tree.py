"""Sources and sinks: trees of files in, segments and generations out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that are never indexed (ours), and the extensions that are.
IGNORED = r"(^|/)(\.git|node_modules|target|dist|build|__pycache__|\.venv)(/|$)"
INDEXED = r"\.(tsx?|jsx?|py|rs|go|java|cs|sh|md|sql|ya?ml|toml|json|c|h|cpp|hpp|lua|glsl|kt)$"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """SRC-WALK and SRC-READ: (path, size, mtime, hash, lines, text) of the indexable files of a tree.

    Files with a NUL in the first 8 KiB are binary and left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = raw.where(~F.col("path").rlike(IGNORED) & F.col("path").rlike(INDEXED))
    text = kept.where(~F.contains(F.decode(F.substring("content", 1, 8192), "ISO-8859-1"), F.lit("\0")))
    body = F.decode("content", "UTF-8")
    return text.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), F.size(F.split(body, "\n", -1)).cast("bigint").alias("lines"), body.alias("text"))


def write_segment(df: DataFrame, store: str, segment: int) -> None:
    """SNK-SEGMENT: an immutable segment; writing one that exists fails."""
    df.write.mode("error").parquet(f"{store}/segment={segment}")


def read_segments(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.option("basePath", store).parquet(store)


def current(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """SNK-STORE: sections of each page's last generation, if as many as it declares."""
    last = pages.groupBy("page").agg(F.max_by(F.struct("g", "declared"), "g").alias("x")).select("page", "x.*")
    live = sections.join(last, ["page", "g"])
    return live.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("page", "g"))).where("n = declared").drop("n", "declared")
