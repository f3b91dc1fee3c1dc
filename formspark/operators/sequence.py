"""Serial numbers of a page as a sequence: inference, longest run, outliers, duplicates, gaps.

A page is a group of rows with an order; every function works on all pages at once, with one shuffle by
page at most.  Serials are integers, null where missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import corrected_serial, let


def infer_serials(df: DataFrame, page: list[str], order: list[str], serial: str = "serial", out: str = "inferred") -> DataFrame:
    """Fill missing serials from the nearest known one before, else after, by distance in the page.

    Only the given serials count as known.  A page without any stays as it is.
    """
    w = Window.partitionBy(*page).orderBy(*order)
    pos = F.row_number().over(w)
    offset = F.col(serial) - F.col("_pos")
    before = F.last("_off", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_off", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    placed = df.withColumn("_pos", pos.cast("long")).withColumn("_off", offset)
    return placed.withColumn(out, F.coalesce(F.col(serial), before + F.col("_pos"), after + F.col("_pos"))).drop("_pos", "_off")


def longest_run(df: DataFrame, page: list[str], serial: str = "serial") -> DataFrame:
    """(page, run_start, run_length) of the longest run of consecutive sorted serials.

    A repeated serial breaks a run; of equally long runs the one that starts lowest counts.
    """
    w = Window.partitionBy(*page).orderBy(serial)
    known = df.where(F.col(serial).isNotNull())
    flagged = known.withColumn("_new", F.when(F.col(serial) == F.lag(serial).over(w) + 1, 0).otherwise(1))
    runs = flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by_run = runs.groupBy(*page, "_run").agg(F.min(serial).alias("_start"), F.count("*").alias("_n"))
    best = F.max(F.struct(F.col("_n"), (-F.col("_start")).alias("s")))
    return by_run.groupBy(*page).agg(best.alias("_b")).select(*page, (-F.col("_b.s")).alias("run_start"), F.col("_b._n").alias("run_length"))


def correct_strays(df: DataFrame, page: list[str], order: list[str], serial: str = "serial", out: str = "corrected") -> DataFrame:
    """Serials far from the middle of the page's longest run: one confusable digit away, else inferred anew.

    Pages of fewer than three rows or known serials stay as they are, and serials are inferred
    only on pages where something changed.
    """
    sizes = df.groupBy(*page).agg(F.count("*").alias("_rows"), F.count(serial).alias("_known"))
    about = sizes.join(longest_run(df, page, serial), page, "left")
    anchor = F.col("run_start") + F.floor(F.col("run_length") / 2)
    reach = F.greatest(F.col("_rows") + 5, F.lit(20))
    low, high = anchor - reach, anchor + reach
    stray = (F.col("_rows") >= 3) & (F.col("_known") >= 3) & F.col(serial).isNotNull() & ~F.col(serial).between(low, high) & (F.col(serial) != 0)
    marked = df.join(about, page, "left").withColumn("_stray", F.coalesce(stray, F.lit(False)))
    fixed = marked.withColumn("_fixed", F.when(F.col("_stray"), corrected_serial(F.col(serial), low, high)).otherwise(F.col(serial)))
    changed = F.max("_stray").over(Window.partitionBy(*page))
    inferred = infer_serials(fixed.withColumn("_changed", changed), page, order, "_fixed", "_filled")
    return inferred.withColumn(out, F.when(F.col("_changed"), F.col("_filled")).otherwise(F.col("_fixed"))).drop(
        "_rows", "_known", "run_start", "run_length", "_stray", "_fixed", "_changed", "_filled"
    )


def serial_gaps(df: DataFrame, page: list[str], serial: str = "serial", slack: int = 5, least: int = 20) -> DataFrame:
    """(page, gaps, n_missing): the numbers missing between the smallest and the largest serial.

    Neighbours among the sorted serials bound intervals of missing numbers.  One that is no longer than
    the page's reach (its known serials and ``slack`` more, ``least`` at least) is written out; a longer one
    comes from a stray serial, so it only counts in n_missing.
    """
    known = df.where(F.col(serial).isNotNull()).withColumn("_s", F.col(serial).cast("long"))
    w = Window.partitionBy(*page)
    placed = known.withColumn("_next", F.lead("_s").over(w.orderBy("_s"))).withColumn("_reach", F.greatest(F.count("*").over(w) + slack, F.lit(least)))
    missing = F.greatest(F.coalesce(F.col("_next") - F.col("_s") - 1, F.lit(0)), F.lit(0))
    numbers = F.when((missing > 0) & (missing <= F.col("_reach")), F.sequence(F.col("_s") + 1, F.col("_next") - 1))
    found = placed.select(*page, missing.alias("_n"), numbers.alias("_gap"))
    return found.groupBy(*page).agg(F.sort_array(F.flatten(F.collect_list("_gap"))).alias("gaps"), F.sum("_n").alias("n_missing"))


def unrepeated(serials: Column) -> Column:
    """The serials of a page, in their order, with every number once where that is possible.

    The repeated numbers are folded over in the order in which they first come.  Each looks for the free
    number nearest to it: the one below or above the run of taken numbers around it, if it is inside the
    page's range, the lower one of equals.  The row of the repeated number that stands nearest to that
    number's place takes it.  Where none is free the later rows are cleared and inferred from the row before.
    """

    def folded(values: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(values) - 1)
        given = F.array_distinct(F.filter(values, lambda x: x.isNotNull()))
        low, high = F.array_min(given), F.array_max(given)
        where = lambda v: F.filter(places, lambda i: F.get(values, i) == v)
        repeated = F.filter(given, lambda v: F.size(where(v)) > 1)

        def free(v: Column, taken: Column) -> Column:
            below = F.array_max(F.filter(taken, lambda x: (x <= v) & ~F.array_contains(taken, x - 1))) - 1
            above = F.array_min(F.filter(taken, lambda x: (x >= v) & ~F.array_contains(taken, x + 1))) + 1
            lower, upper = F.when(below > low, below), F.when(above < high, above)
            return F.when(upper.isNull() | (v - lower <= upper - v), lower).otherwise(upper)

        def inferred(cleared: Column) -> Column:
            known = F.filter(places, lambda i: F.get(cleared, i).isNotNull())
            nearest = lambda i: F.coalesce(F.array_max(F.filter(known, lambda k: k < i)), F.get(known, F.lit(0)))
            return F.transform(cleared, lambda x, i: F.coalesce(x, let(nearest(i), lambda k: F.get(cleared, k) + i - k)))

        def step(state: Column, v: Column) -> Column:
            taken, now, at = state["taken"], state["now"], where(v)
            chosen = lambda g: F.array_min(F.transform(at, lambda i: F.struct(F.abs(i - (g - low)).alias("away"), i.alias("i"))))["i"]
            placed = lambda g: let(chosen(g), lambda c: F.transform(now, lambda x, i: F.when(i == c, g).otherwise(x)))
            cleared = F.transform(now, lambda x, i: F.when((F.get(values, i) == v) & (i > F.get(at, F.lit(0))), F.lit(None)).otherwise(x))
            return let(free(v, taken), lambda g: F.struct(
                F.when(g.isNotNull(), F.concat(taken, F.array(g))).otherwise(taken).alias("taken"),
                F.when(g.isNotNull(), placed(g)).otherwise(let(cleared, inferred)).alias("now"),
            ))

        return F.aggregate(repeated, F.struct(given.alias("taken"), values.alias("now")), step)["now"]

    return let(serials, folded)


def repair_duplicates(df: DataFrame, page: list[str], order: list[str], serial: str = "serial", out: str = "repaired") -> DataFrame:
    """Every serial of a page once: ``unrepeated`` over the array of a page's rows, which are some thirty."""
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(serial).cast("long").alias("serial"), F.struct("*").alias("row"))
    pages = df.groupBy(*page).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    fixed = pages.select("_rows", unrepeated(F.transform("_rows", lambda r: r["serial"])).alias("_fixed"))
    return fixed.select(F.explode(F.arrays_zip("_rows", "_fixed")).alias("_z")).select("_z._rows.row.*", F.col("_z._fixed").alias(out))


def cell_position(index: Column, columns: int = 3) -> Column:
    """(row, column) of a cell by its index."""
    return F.struct(F.floor(index / columns).cast("int").alias("row"), F.pmod(index, F.lit(columns)).cast("int").alias("col"))


def odd_pages(df: DataFrame, page: list[str], low: int = 28, high: int = 32) -> DataFrame:
    """Pages with fewer or more records than a full grid has."""
    return df.groupBy(*page).agg(F.count("*").alias("n_records")).where(~F.col("n_records").between(low, high))


def trim_trailing(df: DataFrame, page: list[str], index: str, valid: Column, columns: int = 3) -> DataFrame:
    """Records up to the last grid row of a page that has a valid record; a page without any goes."""
    row = F.floor(F.col(index) / columns)
    last = F.max(F.when(valid, row)).over(Window.partitionBy(*page))
    return df.withColumn("_last", last).where(row <= F.col("_last")).drop("_last")
