"""Agreement between readers of one cell, and identifier prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import VALID_ID, blank


def majority(df: DataFrame, cell: list[str], reader: str = "reader_ord", value: str = "value", out: str = "voted") -> DataFrame:
    """The value most readers agree on (two at least), else that of the first reader with any; blank without."""
    said = df.withColumn("_v", blank(F.col(value)))
    counts = said.where("_v <> ''").groupBy(*cell, "_v").agg(F.count("*").alias("_n"), F.min(reader).alias("_o"))
    rank = F.struct(F.when(F.col("_n") >= 2, F.col("_n")).otherwise(0).alias("n"), (-F.col("_o")).alias("o"), F.col("_v").alias("v"))
    best = counts.groupBy(*cell).agg(F.max(rank).alias("_b")).select(*cell, F.col("_b.v").alias(out))
    return df.select(*cell).distinct().join(best, cell, "left").withColumn(out, blank(F.col(out)))


def confidence_vote(df: DataFrame, cell: list[str], reader: str = "reader_ord", value: str = "value", confidence: str = "confidence") -> DataFrame:
    """(cell, voted, voted_confidence) among valid identifiers.

    Two readers that agree give the best confidence plus 10, 100 at most; else the most confident
    reading counts, the earlier reader of equals; none gives blank and 0.
    """
    good = df.where(F.col(value).rlike(VALID_ID))
    by_id = good.groupBy(*cell, value).agg(F.count("*").alias("_n"), F.max(confidence).alias("_c"), F.min(reader).alias("_o"))
    rank = F.struct(
        (F.col("_n") >= 2).cast("int").alias("agree"), F.when(F.col("_n") >= 2, F.col("_n")).otherwise(0).alias("n"),
        F.col("_c").alias("c"), (-F.col("_o")).alias("o"), F.col(value).alias("v"),
    )
    best = by_id.groupBy(*cell).agg(F.max(rank).alias("_b"))
    conf = F.when(F.col("_b.agree") == 1, F.least(F.col("_b.c") + 10, F.lit(100.0))).otherwise(F.col("_b.c"))
    named = best.select(*cell, F.col("_b.v").alias("voted"), conf.cast("double").alias("voted_confidence"))
    return df.select(*cell).distinct().join(named, cell, "left").select(
        *cell, blank(F.col("voted")).alias("voted"), F.coalesce("voted_confidence", F.lit(0.0)).alias("voted_confidence")
    )


def decide_id(epic: Column, voted: Column, voted_confidence: Column) -> Column:
    """(epic, confidence) from the parsed identifier and the vote, by the table of thresholds."""
    epic, voted = blank(epic), blank(voted)
    valid, has_vote = epic.rlike(VALID_ID), voted != ""
    return (
        F.when((epic == "") & has_vote, F.struct(voted.alias("epic"), voted_confidence.alias("confidence")))
        .when(valid & has_vote & (voted != epic) & (voted_confidence >= 70), F.struct(voted.alias("epic"), voted_confidence.alias("confidence")))
        .when(valid & has_vote, F.struct(epic.alias("epic"), voted_confidence.alias("confidence")))
        .when(valid, F.struct(epic.alias("epic"), F.lit(50.0).alias("confidence")))
        .otherwise(F.struct(epic.alias("epic"), F.lit(100.0).alias("confidence")))
    )


def first_good(readings: Column, good) -> Column:
    """The first reading of an array that is good, else the one with the most characters, the first of equals; blank of none."""
    hits = F.filter(readings, good)
    longest = F.aggregate(readings, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.coalesce(F.get(hits, F.lit(0)), longest)


def prefix_frequency(df: DataFrame, epic: str = "epic_id") -> DataFrame:
    """(prefix, n) of the first three letters of valid identifiers."""
    return df.where(F.col(epic).rlike(VALID_ID)).groupBy(F.substring(epic, 1, 3).alias("prefix")).agg(F.count("*").alias("n"))


def recovered_prefixes(frequency: DataFrame, share: float = 0.8, least: int = 5) -> DataFrame:
    """(two, prefix): for two letters the prefix they are the end of, else the begin, where one is dominant."""
    ends = frequency.select(F.substring("prefix", 2, 2).alias("two"), F.lit(0).alias("_kind"), "prefix", "n")
    begins = frequency.select(F.substring("prefix", 1, 2).alias("two"), F.lit(1).alias("_kind"), "prefix", "n")
    kinds = ends.unionByName(begins).groupBy("two", "_kind").agg(F.sum("n").alias("_all"), F.max(F.struct("n", "prefix")).alias("_best"))
    first = Window.partitionBy("two").orderBy("_kind")
    chosen = kinds.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return chosen.where((F.col("_best.n") / F.col("_all") >= share) & (F.col("_best.n") >= least)).select("two", F.col("_best.prefix").alias("prefix"))
