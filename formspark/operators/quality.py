"""Fill rates, issue counts, completeness and anomalies of record tables, each in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import VALID_ID, blank, is_contaminated, percent, strip, unguarded


def filled(c: str | Column) -> Column:
    return strip(F.col(c) if isinstance(c, str) else c) != ""


def fill_rates(df: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, field, filled, total, pct) in long form."""
    sums = [F.sum(filled(c).cast("long")).alias(f"_{i}") for i, c in enumerate(fields)]
    wide = df.groupBy(*(by or [])).agg(F.count("*").alias("total"), *sums)
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("filled")) for i, c in enumerate(fields)]))
    long = wide.select(*(by or []), "total", stacked.alias("_s")).select(*(by or []), "_s.field", "_s.filled", "total")
    return long.withColumn("pct", percent(F.col("filled"), F.col("total")))


def core_rate(df: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """Filled cells over all cells of some fields."""
    cells = sum((filled(c).cast("long") for c in fields), F.lit(0))
    return df.groupBy(*(by or [])).agg(F.sum(cells).alias("filled"), (F.count("*") * len(fields)).alias("cells")).withColumn(
        "pct", percent(F.col("filled"), F.col("cells"))
    )


def issue_counts(df: DataFrame, issues: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Rows that have each issue, and their share in percent."""
    counts = df.groupBy(*(by or [])).agg(F.count("*").alias("total"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in issues.items()])
    return counts.select("*", *[percent(F.col(k), F.col("total")).alias(f"{k}_pct") for k in issues])


def standard_issues(cols: dict[str, str]) -> dict[str, Column]:
    """The eleven issues of a record table; cols names its columns."""
    c = {k: strip(F.col(v)) for k, v in cols.items()}
    out = {"id_empty": c["epic"] == "", "id_malformed": (c["epic"] != "") & ~c["epic"].rlike(VALID_ID)}
    out |= {f"{k}_blank": c[k] == "" for k in ("name_en", "name_ta", "rel_en", "rel_ta", "age", "gender", "house")}
    return out | {f"{k}_contaminated": (c[k] != "") & is_contaminated(c[k]) for k in ("name_ta", "rel_ta")}


def complete_rows(df: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """Rows whose fields are all filled, for each group and in total (a null group)."""
    whole = F.lit(True)
    for c in fields:
        whole = whole & filled(c)
    return df.rollup(*by).agg(F.count("*").alias("total"), F.sum(whole.cast("long")).alias("complete")).withColumn(
        "pct", percent(F.col("complete"), F.col("total"))
    )


def distinct_values(df: DataFrame, columns: list[str], first: dict[str, int] | None = None) -> DataFrame:
    """(field, value): the distinct values of each column, blanks included, as rows.

    Of the columns in ``first`` only the first so many in string order.  Values are combined before their
    shuffle and never meet in one row or task.
    """
    named = F.array(*[F.struct(F.lit(c).alias("field"), blank(F.col(c).cast("string")).alias("value")) for c in columns])
    values = df.select(F.explode(named).alias("_s")).select("_s.field", "_s.value").distinct()
    cut = [values.where(F.col("field") == c).orderBy("value").limit(n) for c, n in (first or {}).items()]
    return reduce(DataFrame.unionAll, cut, values.where(~F.col("field").isin(*(first or {}))) if first else values)


def samples(df: DataFrame, value: Column, order: list[str], by: list[str], n: int) -> DataFrame:
    """(by, sample, n_all): the first n values that are not null, by order; a bounded buffer for each group.

    The ranking keeps n rows of a group in each task before its shuffle; the numbers are counted apart.
    """
    given = df.select(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], value.alias("_v")).where("_v is not null")
    w = Window.partitionBy(*by).orderBy(*[f"_o{i}" for i in range(len(order))])
    ranked = given.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    firsts = ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias("sample"))
    counts = given.groupBy(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("n_all"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)], F.lit(True))
    return firsts.join(counts, same).select(*by, "sample", "n_all")


def anomaly_rules(cols: dict[str, str], prefixes: list[str], relations: list[str], max_part: int = 400) -> dict[str, tuple[Column, Column]]:
    """The twenty rules: name to (condition, detail).  cols names the columns of the record table."""
    c = {k: strip(F.col(v)) for k, v in cols.items()}
    digits = "^[0-9]+$"
    n = lambda x: F.when(x.rlike("^[0-9]{1,9}$"), x.cast("int"))
    ascii_only = lambda x: ~x.rlike(r"[^\x00-\x7F]")
    quoted = lambda x: F.concat(F.lit("'"), F.substring(x, 1, 40), F.lit("'"))
    given = lambda k, cond: (c[k] != "") & cond
    no_space = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    bare = unguarded(c["house"])
    rules = {
        "unexpected_gender": ("gender", ~c["gender"].isin("Male", "Female")),
        "unexpected_relation_type": ("rel_type", ~c["rel_type"].isin(*relations)),
        "serial_not_numeric": ("serial", ~c["serial"].rlike(digits)),
        "age_out_of_range": ("age", F.coalesce(~n(c["age"]).between(18, 120), F.lit(False))),
        "age_non_numeric": ("age", n(c["age"]).isNull()),
        "house_only_apostrophe": ("house", c["house"] == "'"),
        "english_name_non_ascii": ("name_en", ~ascii_only(c["name_en"])),
        "rel_name_en_non_ascii": ("rel_en", ~ascii_only(c["rel_en"])),
        "epic_unknown_prefix": ("epic", c["epic"].rlike(VALID_ID) & ~F.substring(c["epic"], 1, 3).isin(*prefixes)),
        "part_not_numeric": ("part", ~c["part"].rlike(digits)),
        "ac_not_numeric": ("ac", ~c["ac"].rlike(digits)),
        "tamil_name_all_ascii": ("name_ta", ascii_only(c["name_ta"])),
        "tamil_rel_all_ascii": ("rel_ta", ascii_only(c["rel_ta"])),
        "english_name_very_short": ("name_en", F.length(c["name_en"]) <= 2),
        "tamil_name_very_short": ("name_ta", F.length(c["name_ta"]) <= 3),
        "house_very_long": ("house", F.length(bare) > 20),
        "english_name_digits_only": ("name_en", no_space(c["name_en"]).rlike(digits)),
        "english_name_looks_like_epic": ("name_en", no_space(c["name_en"]).rlike(VALID_ID)),
        "house_number_suspiciously_large": ("house", bare.rlike("^[0-9]{5,}$")),
        "part_out_of_range": ("part", F.coalesce(~n(c["part"]).between(1, max_part), F.lit(False))),
    }
    return {k: (given(col, cond), quoted(c[col])) for k, (col, cond) in rules.items()}


def anomalies(df: DataFrame, rules: dict[str, tuple[Column, Column]], order: list[str], n: int = 5) -> DataFrame:
    """(type, n, sample): how often each rule holds and the details of its first rows, in one pass.

    Rows are exploded by rule; the samples come from a ranking whose first rows alone are kept in each
    task, so that no type gathers more than n rows in one place.
    """
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(k).alias("type"), detail.alias("detail"))) for k, (cond, detail) in rules.items()]))
    each = df.select(*order, F.explode(hits).alias("_h")).select(*order, "_h.type", "_h.detail")
    counts = each.groupBy("type").agg(F.count("*").alias("n"))
    ranked = each.withColumn("_k", F.row_number().over(Window.partitionBy("type").orderBy(*order, "detail"))).where(F.col("_k") <= n)
    firsts = ranked.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "detail"))), lambda s: s["detail"]).alias("sample"))
    return counts.join(firsts, "type")


def file_issues(counts: DataFrame, first: str = "n_first", second: str = "n_second") -> DataFrame:
    """Directories with an array of what is wrong with their file counts; empty where nothing is."""
    a, b = F.col(first), F.col(second)
    return counts.withColumn("issues", F.array_compact(F.array(
        F.when(a == 0, F.lit("no first-language files")), F.when(b == 0, F.lit("no second-language files")),
        F.when((a > 0) & (b > 0) & (a != b), F.concat(F.lit("file counts differ: "), a, F.lit(" vs "), b)),
    )))
