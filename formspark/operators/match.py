"""Pairing pages of two languages, and matching their records by identifier, serial and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, clean_house_plain, let, unguarded


def candidate_pairs(first: DataFrame, second: DataFrame, part: list[str] | None = None) -> DataFrame:
    """Every page of the first language with all pages of its part in the second; pages without one stay.

    A part is named by its number, and where a table has several constituencies by theirs as well.
    """
    keys = part or ["part_no"]
    other = second.select(*keys, F.col("page_no").alias("other_page"), F.col("path").alias("other_path"))
    return first.join(other, keys, "left")


def page_overlap(first: DataFrame, second: DataFrame, part: str = "part_no", cells: int = 6, most: int = 3) -> DataFrame:
    """(part, page, other_page, score): how many of the first cells of the other page have an identifier of the page."""
    ids = first.where(blank(F.col("epic_id")) != "").select(part, F.col("page_no").alias("page"), "epic_id").distinct()
    probe = second.where((F.col("cell_index") < cells) & (blank(F.col("epic_id")) != "")).select(
        part, F.col("page_no").alias("other_page"), "cell_index", "epic_id"
    )
    hits = ids.join(probe, [part, "epic_id"]).groupBy(part, "page", "other_page").agg(F.countDistinct("cell_index").alias("_n"))
    return hits.select(part, "page", "other_page", F.least("_n", F.lit(most)).cast("long").alias("score"))


def best_page(candidates: DataFrame, page: list[str], own: str = "page", other: str = "other_page", score: str = "score", has_ids: str = "has_ids") -> DataFrame:
    """(page, other): the candidate of the best tier, pages without any candidate tier left out.

    Tiers: same, next or previous page with a score of two; the same three with one; any other page
    with one, in order; the next page; the same page.  The first three need identifiers on the page.
    """
    away = F.col(other) - F.col(own)
    near = F.when(away == 0, 0).when(away == 1, 1).when(away == -1, 2)
    s, ids = F.coalesce(F.col(score), F.lit(0)), F.col(has_ids)
    rank = lambda tier, order: F.struct(F.lit(tier).alias("tier"), order.cast("long").alias("ord"), F.col(other).alias("o"))
    choice = (
        F.when(ids & near.isNotNull() & (s >= 2), rank(1, near)).when(ids & near.isNotNull() & (s >= 1), rank(2, near))
        .when(ids & near.isNull() & (s >= 1), rank(3, F.col(other))).when(away == 1, rank(4, F.lit(0))).when(away == 0, rank(5, F.lit(0)))
    )
    return candidates.withColumn("_c", choice).groupBy(*page).agg(F.min("_c").alias("_b")).where("_b is not null").select(*page, F.col("_b.o").alias("best_other"))


def last_by_key(entries: DataFrame, page: list[str], key: str, index: str = "cell_index") -> DataFrame:
    """One entry for each page and key: that of the last cell.  Blank keys are no keys."""
    others = [c for c in entries.columns if c not in (*page, key)]
    return (
        entries.where(blank(F.col(key).cast("string")) != "").groupBy(*page, key)
        .agg(F.max_by(F.struct(*others), F.col(index)).alias("_e")).select(*page, key, *[F.col("_e")[c].alias(c) for c in others])
    )


def match_records(records: DataFrame, entries: DataFrame, page: list[str]) -> DataFrame:
    """Names of the second language for every record, by identifier, then serial, then place.

    records: page, cell_index, epic_id, epic_confidence, serial_no.  entries: page, cell_index, epic_id,
    serial_no, name, relation.  An identifier of a confidence of 70 or more takes its entry even if blank;
    a serial is asked only while the name is blank, and takes blanks too; a place only gives names.
    Below 80 a different name at the place wins over the identifier's.
    """

    def side(key: str, tag: str) -> DataFrame:
        kept = last_by_key(entries.select(*page, "cell_index", "epic_id", "serial_no", "name", "relation"), page, key)
        own = f"_{tag}"
        return kept.select(*page, F.col(key).alias(own), blank(F.col("name")).alias(f"{own}_name"), blank(F.col("relation")).alias(f"{own}_rel"))

    by_id, by_serial, by_place = side("epic_id", "i"), side("serial_no", "s"), side("cell_index", "p")
    r = records.withColumn("_i", blank(F.col("epic_id"))).withColumn("_s", blank(F.col("serial_no"))).withColumn("_p", F.col("cell_index"))
    j = r.join(by_id, [*page, "_i"], "left").join(by_serial, [*page, "_s"], "left").join(by_place, [*page, "_p"], "left")
    use_id = F.col("_i_name").isNotNull() & (F.col("epic_confidence") >= 70)
    j = j.withColumn("_n1", F.when(use_id, F.col("_i_name")).otherwise("")).withColumn("_r1", F.when(use_id, F.col("_i_rel")).otherwise(""))
    j = j.withColumn("_m1", F.when(use_id, "id").otherwise(""))
    use_serial = (F.col("_n1") == "") & F.col("_s_name").isNotNull()
    j = j.withColumn("_n2", F.when(use_serial, F.col("_s_name")).otherwise(F.col("_n1"))).withColumn("_r2", F.when(use_serial, F.col("_s_rel")).otherwise(F.col("_r1")))
    j = j.withColumn("_m2", F.when(use_serial, "serial").otherwise(F.col("_m1")))
    place = blank(F.col("_p_name"))
    use_place = (F.col("_n2") == "") & (place != "")
    doubt = (F.col("_m2") == "id") & (F.col("epic_confidence") < 80) & (place != "") & (place != F.col("_n2"))
    take = use_place | doubt
    drop = ["_i", "_s", "_p", *[f"_{t}_{c}" for t in "isp" for c in ("name", "rel")], "_n1", "_r1", "_m1", "_n2", "_r2", "_m2"]
    return (
        j.withColumn("name", F.when(take, place).otherwise(F.col("_n2")))
        .withColumn("relation", F.when(take, blank(F.col("_p_rel"))).otherwise(F.col("_r2")))
        .withColumn("match_method", F.when(use_place, "position").when(doubt, "position_override").otherwise(F.col("_m2")))
        .drop(*drop)
    )


def backfill_serials(records: DataFrame, entries: DataFrame, page: list[str]) -> DataFrame:
    """Serials of records without one, from the first cell of the other side with the same identifier and a serial."""
    known = entries.where((blank(F.col("epic_id")) != "") & (blank(F.col("serial_no")) != ""))
    serials = known.groupBy(*page, "epic_id").agg(F.min_by("serial_no", "cell_index").alias("_serial"))
    joined = records.join(serials, [*page, "epic_id"], "left")
    return joined.withColumn("serial_no", F.when(blank(F.col("serial_no")) == "", blank(F.col("_serial"))).otherwise(F.col("serial_no"))).drop("_serial")


def cross_check(a: dict[str, Column], b: dict[str, Column], paired: Column) -> tuple[Column, Column]:
    """(status, notes) of two readings of a record with the keys epic, house, serial and name.

    Values are compared where both are given, house numbers cleaned on both sides; names by their
    lengths.  REVIEW with any note, else OK; records without a second page are UNVERIFIED.
    """

    def differ(x: Column, y: Column, what: str) -> Column:
        return F.when((x != "") & (y != "") & (x != y), F.concat(F.lit(f"{what}: "), x, F.lit(" vs "), y))

    x, y = (clean_house_plain(unguarded(side["house"])) for side in (a, b))
    house = let(F.struct(x.alias("x"), y.alias("y")), lambda h: differ(h["x"], h["y"], "house"))
    ratio = F.length(blank(a["name"])) / F.nullif(F.length(blank(b["name"])), F.lit(0))
    notes = F.concat_ws("; ", F.array_compact(F.array(
        differ(blank(a["epic"]), blank(b["epic"]), "id"), house, differ(blank(a["serial"]), blank(b["serial"]), "serial"),
        F.when((blank(a["name"]) != "") & ((ratio > 5) | (ratio < 0.2)), F.lit("name length")),
    )))
    return F.when(~paired, "UNVERIFIED").when(notes != "", "REVIEW").otherwise("OK"), notes
