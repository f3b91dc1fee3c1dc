"""Ordered merges from pages to parts to the whole, and progress over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, percent, strip

LAST = 999_999


def number_or(c: Column, sentinel: int) -> Column:
    """A text as a sort key: its number, or the sentinel where it is none."""
    s = strip(c)
    return F.when(s.rlike("^[+-]?[0-9]{1,9}$"), s.cast("int")).otherwise(sentinel)


def merged_part(pages: DataFrame, serial: str = "serial_no", page: str = "page_no", row: str = "row_no") -> DataFrame:
    """Rows of a part by serial, then page and row; without a number they come last."""
    return pages.orderBy(number_or(F.col(serial), LAST), page, row)


def merged_all(parts: DataFrame, part: str = "part_no", serial: str = "serial_no", ties: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Rows of all parts by part and serial: a range partitioning and sorted partitions, whose order is total."""
    keyed = parts.withColumn("_p", number_or(F.col(part), LAST)).withColumn("_s", number_or(F.col(serial), LAST))
    keys = ["_p", "_s", *(ties or [])]
    dealt = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).drop("_p", "_s")


def page_order(df: DataFrame, serial: str = "serial_no", ties: list[str] | None = None) -> DataFrame:
    """Rows of a page for writing: without a number they come first."""
    return df.orderBy(number_or(F.col(serial), 0), *(ties or []))


def bag_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; columns that a frame lacks are blank."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*[blank(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def progress(manifest: DataFrame, directory: str = "directory") -> DataFrame:
    """Totals, done, pending, records and percent of each directory, and of all (a null directory).

    manifest: directory, done (boolean) and n_records of each page.
    """
    out = manifest.rollup(directory).agg(
        F.count("*").alias("total"), F.sum(F.col("done").cast("long")).alias("done"), F.sum(F.when(F.col("done"), F.col("n_records")).otherwise(0)).alias("records")
    )
    return out.withColumn("pending", F.col("total") - F.col("done")).withColumn("pct", percent(F.col("done"), F.col("total")))


def workers_for(cores: int, ram_gb: float, per_worker_gb: float = 0.5) -> int:
    return max(1, min(cores - 1, int(ram_gb / per_worker_gb)))


def disk_state(free_bytes: Column, pending: Column, each: int = 50 * 1024) -> Column:
    """danger below what the pending pages need, warning below twice that, else ok."""
    need = pending * each
    return F.when(free_bytes < need, "danger").when(free_bytes < 2 * need, "warning").otherwise("ok")


def directory_summary(manifest: DataFrame, counts: DataFrame, runs: DataFrame, directory: str = "directory") -> DataFrame:
    """Progress of each directory with its file issues, its state and its last run.

    manifest: directory, done, n_records; counts: directory, n_first, n_second; runs: directory, completed
    and any other columns of the run log.  A directory without runs has a null last_run.
    """
    from .quality import file_issues

    last = runs.groupBy(directory).agg(F.max_by(F.struct(*[c for c in runs.columns if c != directory]), "completed").alias("last_run"))
    done = progress(manifest, directory).where(F.col(directory).isNotNull())
    out = done.join(file_issues(counts), directory, "left").join(last, directory, "left")
    state = F.when(F.col("pending") == 0, "complete").when(F.col("done") > 0, "partial").otherwise("new")
    return out.withColumn("state", state).withColumn("valid", F.coalesce(F.size("issues") == 0, F.lit(False)))
