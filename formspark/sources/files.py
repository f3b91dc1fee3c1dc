"""Readers: page documents, record CSV files, logs and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import blank, log_severity

# The columns of a record file, and the two that cross-checked files add.
RECORD_COLUMNS = [
    "AC No", "Part No", "Serial No", "EPIC ID", "Name (English)", "Name (Tamil)", "Relation Name (English)",
    "Relation Name (Tamil)", "Relation Type", "House No", "Age", "Gender", "DOB", "ContactNo",
]
CHECK_COLUMNS = ["Cross_Check", "Cross_Check_Notes"]
RECORD_SCHEMA = StructType([StructField(c, StringType()) for c in [*RECORD_COLUMNS, *CHECK_COLUMNS]])
# Fixed value: the form of a page document's name; the language token stands in the middle.
PAGE_NAME = r"^(\d+)-EROLLGEN-S(\d+)-(\d+)-(\w+)-FinalRoll-Revision(\d+)-%s-(\d+)-WI_page_(\d+)\.pdf$"
NAME_FIELDS = ["year", "state_code", "ac_no", "ac_abbr", "revision", "part_no"]


def documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """All documents beneath a folder: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def page_metadata(files: DataFrame, language: str = "ENG", name: Column | None = None) -> DataFrame:
    """Fields of page file names of one language; other names are left out.  All but page_no are strings."""
    n = file_name(F.col("path")) if name is None else name
    pattern = PAGE_NAME % language
    fields = [F.regexp_extract(n, pattern, i + 1).alias(f) for i, f in enumerate(NAME_FIELDS)]
    return files.where(n.rlike(pattern)).select("*", n.alias("filename"), *fields, F.regexp_extract(n, pattern, 7).cast("int").alias("page_no"))


def split_pages(docs: DataFrame, text: str = "text", separator: str = "\f", skip_pages: int = 0, page: str = "page_no") -> DataFrame:
    """One row for each page of a text, numbered from 1; the first skip_pages go."""
    split = docs.select("*", F.posexplode(F.split(blank(F.col(text)), separator)).alias("_p", "page_text"))
    return split.where(F.col("_p") >= skip_pages).withColumn(page, F.col("_p") + 1).drop("_p")


def record_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Record CSV files by column name; a missing column or value is blank.  Adds file, part key and page.

    Quotes are doubled inside quoted values and values may hold line ends.
    """
    reader = spark.read.schema(RECORD_SCHEMA).option("header", True).option("escape", '"').option("multiLine", True)
    df = reader.option("enforceSchema", True).csv(list(paths)).select("*", F.col("_metadata.file_name").alias("file"))
    return with_page_key(df.select(*[blank(F.col(c)).alias(c) for c in RECORD_SCHEMA.names], "file"))


def with_page_key(df: DataFrame, file: str = "file") -> DataFrame:
    """part_key: the file name without its page; page: the number at its end, null without one."""
    stem = F.regexp_replace(F.col(file), r"\.csv$", "")
    page = F.regexp_extract(stem, r"_page_(\d+)$", 1)
    return df.withColumn("part_key", F.regexp_replace(stem, r"_page_\d+$", "")).withColumn("page", F.when(page != "", page.cast("int")))


def with_legacy(new: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Rows of the new layout, and of the legacy layout for keys that the new one lacks."""
    return new.unionByName(legacy.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def directories(files: DataFrame) -> DataFrame:
    """Directories that hold first-language documents, sorted."""
    found = F.regexp_extract("path", r"/(AC-\d{1,3})/english/", 1)
    return files.select(found.alias("directory")).where("directory <> ''").distinct().orderBy("directory")


def newest_preview(rows: DataFrame, key: str, modified: str, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows of the file modified last."""
    newest = rows.agg(F.max_by(key, F.struct(modified, key)).alias("_newest"))
    return rows.join(F.broadcast(newest), F.col(key) == F.col("_newest")).drop("_newest").orderBy(*order).limit(n)


def tail(lines: DataFrame, order: list[str], n: int = 500) -> DataFrame:
    """The last n lines with their severity."""
    return lines.orderBy(*[F.col(c).desc() for c in order]).limit(n).withColumn("severity", log_severity(F.col("line")))


def log_listing(files: DataFrame, n: int = 100) -> DataFrame:
    """Logs and run summaries, the newest first, with their size in KB."""
    name = file_name(F.col("path"))
    shown = files.where(name.rlike(r"\.(log|json)$")).select(name.alias("name"), F.bround(F.col("length") / 1024.0, 1).alias("size_kb"), "modificationTime")
    return shown.orderBy(F.col("modificationTime").desc(), "name").limit(n)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one log in a folder of logs; a path that leaves the folder is refused."""
    if ".." in path.split("/"):
        raise ValueError("the path leaves the folder")
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("line_no"))


def valid_directory(name: str) -> bool:
    """Whether a name is that of a directory of one constituency: AC- and one to three digits."""
    digits = name.removeprefix("AC-")
    return name.startswith("AC-") and digits.isascii() and digits.isdigit() and 1 <= len(digits) <= 3
