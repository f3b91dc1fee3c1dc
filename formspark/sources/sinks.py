"""Writers: ordered record files, page manifests and run logs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, guarded
from ..operators.merge import LAST, merged_all, number_or, page_order
from .files import CHECK_COLUMNS, RECORD_COLUMNS


#: values keep the blanks around them, and quotes are doubled inside quoted ones
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def record_rows(records: DataFrame, mapping: dict[str, str], checked: bool = False) -> DataFrame:
    """The fixed columns of a record file from the columns that mapping names; others are blank, house numbers guarded."""
    out = []
    for c in [*RECORD_COLUMNS, *(CHECK_COLUMNS if checked else [])]:
        value = blank(F.col(mapping[c]).cast("string")) if c in mapping else F.lit("")
        out.append((guarded(value) if c == "House No" else value).alias(c))
    return records.select(*out)


def write_pages(rows: DataFrame, path: str, by: list[str], serial: str = "Serial No", mode: str = "overwrite") -> None:
    """Page files, one folder for each page, rows by serial; rerun pages replace their own folder only."""
    ordered = rows.repartition(*by).sortWithinPartitions(*by, F.coalesce(F.expr(f"try_cast(`{serial}` as int)"), F.lit(0)))
    ordered.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).options(**CSV).csv(path)


def write_merged(rows: DataFrame, path: str, part: str = "Part No", serial: str = "Serial No", ties: list[str] | None = None) -> None:
    """The whole, ordered by part and serial; part files follow each other in order."""
    merged_all(rows, part, serial, ties).write.mode("overwrite").options(**CSV).csv(path)


def merge_parts(rows: DataFrame, path: str, manifest: str, key: str = "part_key", serial: str = "Serial No", force: bool = False) -> tuple[int, int]:
    """Write the parts that the manifest does not name, or all with force: how many were written and left.

    A part is a folder of its own that a later run replaces; the manifest gets a row for each.
    """
    spark, there = rows.sparkSession, None
    try:
        there = spark.read.parquet(manifest).select(key).distinct()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    counts = rows.groupBy(key).agg(F.count("*").alias("n_records"))
    new = counts if force or there is None else counts.join(there, key, "left_anti")
    # the manifest's rows come from what is read before anything is written
    done = new.withColumn("merged_at", F.current_timestamp())
    written = done.count()
    if written:
        chosen = rows.join(done.select(key), key, "left_semi")
        ordered = chosen.repartition(key).sortWithinPartitions(key, number_or(F.col(serial), LAST))
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).options(**CSV).csv(path)
        append_manifest(done, manifest)
    return written, counts.count() - written


def write_page_sorted(rows: DataFrame, path: str, serial: str = "Serial No", ties: list[str] | None = None) -> None:
    """One small page in one file, rows without a serial first."""
    page_order(rows, serial, ties).coalesce(1).write.mode("overwrite").options(**CSV).csv(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    """Manifest rows are appended, never rewritten."""
    rows.write.mode("append").parquet(path)


def run_summary(directory: str, started, completed, pairs: int, processed: int, records: int, warnings: int, errors: int, spark) -> DataFrame:
    """One run as a row of the run log."""
    row = (directory, started, completed, round((completed - started).total_seconds(), 1), pairs, processed, records, warnings, errors)
    return spark.createDataFrame(
        [row],
        "directory string, started timestamp, completed timestamp, duration_seconds double, total_pairs long, processed long,"
        " total_records long, warnings long, errors long",
    )


def run_summaries(pages: DataFrame, by: str = "directory") -> DataFrame:
    """Runs as rows of the run log, from a table of their pages.

    pages: the directory, started and completed (timestamps), processed (boolean), n_records, n_warnings, n_errors.
    """
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    first, last = F.min("started"), F.max("completed")
    return pages.groupBy(by).agg(
        first.alias("started"), last.alias("completed"),
        F.bround(F.unix_micros(last.cast("timestamp")) / 1e6 - F.unix_micros(first.cast("timestamp")) / 1e6, 1).alias("duration_seconds"),
        F.count("*").alias("total_pairs"), F.count_if("processed").alias("processed"), count("n_records").alias("total_records"),
        count("n_warnings").alias("warnings"), count("n_errors").alias("errors"),
    )


def download(df: DataFrame) -> Iterator[str]:
    """A merged table as CSV lines, one partition in the driver at a time."""
    import csv
    import io

    def line(values) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(["" if v is None else v for v in values])
        return out.getvalue()

    yield "﻿" + line(df.columns)
    for row in df.toLocalIterator(prefetchPartitions=False):
        yield line(row)


def write_split_pages(pages: DataFrame, path: str, key: str, page: str = "page_no", force: bool = False) -> int:
    """Write page texts by document, those not there yet or all with force; returns how many pages."""
    spark, new = pages.sparkSession, pages
    if not force:
        try:
            there = spark.read.parquet(path).select(key, page).distinct()
            new = pages.join(there, [key, page], "left_anti")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    n = new.count()
    new.write.mode("overwrite" if force else "append").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return n
