"""Incremental processing: what is done is a manifest; what is not is an anti-join or a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import in_ranges


def pending(work: DataFrame, done: DataFrame, key: str, status: str | None = None) -> DataFrame:
    """Work whose key is not in the manifest; with a status column, failed keys stay pending."""
    finished = done.where(F.col(status) == "done") if status else done
    return work.join(finished.select(key).distinct(), key, "left_anti")


def selected(work: DataFrame, parts: str | None = None, pages: str | None = None, limit: int = 0, key: str = "key") -> DataFrame:
    """Part and page filters, then the first so many by key."""
    out = work
    if parts:
        out = out.where(in_ranges(F.col("part_no").cast("int"), parts))
    if pages:
        out = out.where(in_ranges(F.col("page_no").cast("int"), pages))
    return out.orderBy(key).limit(limit) if limit else out


def dry_run(work: DataFrame, key: str = "key", show: int = 10) -> tuple[DataFrame, int]:
    """The first pending rows and how many more there are."""
    total = work.count()
    return work.orderBy(key).limit(show), max(total - show, 0)


def stream_new_files(
    spark: SparkSession, folder: str, schema, checkpoint: str, process: Callable[[DataFrame, int], None], fmt: str = "csv", **options
) -> None:
    """Process files that no earlier run has seen, then stop; the checkpoint is the manifest.

    process gets each micro-batch and its number, and may be called again with the same after a failure.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    for k, v in options.items():
        reader = reader.option(k, v)
    query = reader.load(folder).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def reset(spark: SparkSession, manifest: str, keep) -> None:
    """Rewrite a manifest with the rows that ``keep`` (a condition) names, through a sibling path."""
    kept = spark.read.parquet(manifest).where(keep)
    side = manifest.rstrip("/") + ".next"
    kept.write.mode("overwrite").parquet(side)
    spark.read.parquet(side).write.mode("overwrite").parquet(manifest)


def migrated(spark: SparkSession, old: str, new: str) -> DataFrame:
    """The manifest at the new path; copied from the old one first if only that is there."""
    try:
        return spark.read.parquet(new)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    spark.read.parquet(old).write.mode("errorifexists").parquet(new)
    return spark.read.parquet(new)
