"""Every query over the driver tables, with the SQL that gives the same rows.

Where a query needs records that the tables do not have as such (identifiers, serials, readings, cell
texts), it derives them with one SQL text that Spark and the oracle both run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..operators import geometry as G
from ..operators import match as J
from ..operators import merge as M
from ..operators import quality as Q
from ..operators import sequence as W
from ..operators import vote as V
from ..sources import files as S
from ..sources import sinks as K
from ..streaming import incremental as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived table: the same SQL text, over the tables it names."""
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        if name in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


# ---------------------------------------------------------------- derived tables

#: lines of orders as the records of pages; serials are sometimes missing or misread
REC = """SELECT l_orderkey AS page,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS cell_index,
  CAST(CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 41 = 0 THEN l_linenumber + 70 ELSE l_linenumber END AS BIGINT) AS serial,
  l_partkey, l_suppkey FROM lineitem"""

#: records whose serials repeat, are missing or stray by nine digits
DUP = """SELECT l_orderkey AS page,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS cell_index,
  CAST(CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN l_linenumber - 1 WHEN l_partkey % 13 = 0 THEN l_linenumber + 3
       WHEN l_partkey % 37 = 0 THEN l_linenumber + 900000000 ELSE l_linenumber END AS BIGINT) AS serial FROM lineitem"""

#: customers as people with misread identifiers, names, ages and house numbers
PEOPLE = """SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS part,
  CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN concat(' rvj ', lpad(CAST(c_custkey AS VARCHAR(20)), 7, 'O'))
       WHEN c_custkey % 7 = 0 THEN concat('|8VJ', lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0'), '|')
       WHEN c_custkey % 3 = 0 THEN concat('VJ', lpad(CAST(c_custkey AS VARCHAR(20)), 7, '2'))
       ELSE concat(substring(c_mktsegment, 1, 3), lpad(CAST(c_custkey AS VARCHAR(20)), 7, '0')) END AS raw_id,
  CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'x' ELSE concat(c_mktsegment, ' - ', c_name) END AS name,
  CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 8 = 0 THEN 'n/a' ELSE CAST(c_custkey % 140 AS VARCHAR(20)) END AS age,
  CASE c_custkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' WHEN 2 THEN 'Female' ELSE '' END AS sex,
  CASE WHEN c_custkey % 6 = 0 THEN concat('S', CAST(c_custkey AS VARCHAR(20)), 'A') WHEN c_custkey % 10 = 0 THEN concat('(', CAST(c_custkey % 900 AS VARCHAR(20)), '/4')
       WHEN c_custkey % 15 = 1 THEN '' WHEN c_custkey % 4 = 0 THEN CAST(c_custkey * 1000 AS VARCHAR(20)) ELSE concat('#', CAST(c_custkey % 99 AS VARCHAR(20)), '-B') END AS house,
  CASE c_custkey % 6 WHEN 0 THEN 'Fatner' WHEN 1 THEN 'husb' WHEN 2 THEN 'Mother' WHEN 3 THEN 'fath' WHEN 4 THEN 'other' ELSE '' END AS rel,
  CASE WHEN c_custkey % 12 = 0 THEN '' WHEN c_custkey % 29 = 0 THEN 'x1' ELSE CAST(c_custkey AS VARCHAR(20)) END AS serial FROM customer"""

#: three readers of each line's part number
READINGS = """SELECT l_orderkey AS page, l_partkey AS cell, CAST(r AS INT) AS reader_ord,
  CASE WHEN (l_partkey + r * l_suppkey) % 9 = 0 THEN '' WHEN (l_partkey + r) % 4 = 0 THEN concat('RVJ', lpad(CAST(l_suppkey + r AS VARCHAR(20)), 7, '0'))
       ELSE concat('RVJ', lpad(CAST(l_partkey AS VARCHAR(20)), 7, '0')) END AS value,
  CAST((l_partkey * (r + 3) + l_suppkey) % 101 AS DOUBLE) AS confidence
  FROM (SELECT DISTINCT l_orderkey, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_partkey) t
  CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) readers"""

#: documents with their labels as records with blanks
DOCS = """SELECT d.doc_id, d.source, d.lang, d.text, CASE WHEN d.doc_id % 7 = 0 THEN '' WHEN d.doc_id % 11 = 0 THEN '  ' ELSE d.source END AS src,
  coalesce(CAST(l.quality AS VARCHAR(10)), '') AS quality, coalesce(CAST(l.toxic AS VARCHAR(10)), '') AS toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

#: pages of two languages: orders and the customers' earlier orders, with identifiers from parts
EN = """SELECT CAST(o_custkey % 50 AS BIGINT) AS part_no, CAST(o_orderkey % 40 AS BIGINT) AS page_no, concat('P', CAST(l_partkey % 300 AS VARCHAR(20))) AS epic_id
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 1"""
TA = """SELECT CAST(o_custkey % 50 AS BIGINT) AS part_no, CAST(o_orderkey % 40 AS BIGINT) AS page_no,
  CAST(row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 40 ORDER BY l_partkey, l_suppkey, o_orderkey, l_linenumber) - 1 AS BIGINT) AS cell_index,
  concat('P', CAST(l_partkey % 300 AS VARCHAR(20))) AS epic_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 0"""

#: records and second-language entries of the same pages
LEFT_SIDE = """SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS cell_index,
  CASE WHEN l_partkey % 6 = 0 THEN '' ELSE concat('E', CAST(l_partkey % 50 AS VARCHAR(20))) END AS epic_id,
  CAST((l_partkey * 7 + l_suppkey) % 101 AS DOUBLE) AS epic_confidence,
  CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(l_linenumber AS VARCHAR(20)) END AS serial_no FROM lineitem"""
RIGHT_SIDE = """SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey) - 1 AS BIGINT) AS cell_index,
  CASE WHEN l_partkey % 4 = 0 THEN '' ELSE concat('E', CAST(l_partkey % 50 AS VARCHAR(20))) END AS epic_id,
  CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE CAST(l_linenumber AS VARCHAR(20)) END AS serial_no,
  CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE concat('n', CAST(l_suppkey AS VARCHAR(20))) END AS name, concat('r', CAST(l_partkey % 9 AS VARCHAR(20))) AS relation FROM lineitem"""

STRIP = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"
VALID = "regexp_matches(%s, '^[A-Z]{3}[0-9]{7}$')"


# ---------------------------------------------------------------- merges and progress


@query(
    "merge_part_totals",
    """SELECT l_suppkey AS part_no, count(*) AS records, CAST(sum(l_linenumber) AS BIGINT) AS serial_sum FROM lineitem GROUP BY ROLLUP(l_suppkey)""",
)
def merge_part_totals(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.rollup(F.col("l_suppkey").alias("part_no")).agg(F.count("*").alias("records"), F.sum("l_linenumber").alias("serial_sum"))


_KEY = "CASE WHEN regexp_matches(serial, '^[+-]?[0-9]{1,9}$') THEN CAST(serial AS INT) ELSE %d END"


@query(
    "merge_sort_keys",
    f"""SELECT part, k, serial, {_KEY % 999999} AS merge_key, {_KEY % 0} AS page_key,
        row_number() OVER (PARTITION BY part ORDER BY {_KEY % 999999}, k) AS place FROM ({PEOPLE})""",
)
def merge_sort_keys(spark, d):
    from pyspark.sql import Window

    p = derived(spark, d, PEOPLE)
    key = M.number_or(F.col("serial"), M.LAST)
    place = F.row_number().over(Window.partitionBy("part").orderBy(key, "k")).cast("long")
    return p.select("part", "k", "serial", key.alias("merge_key"), M.number_or(F.col("serial"), 0).alias("page_key"), place.alias("place"))


@query("merge_all", f"SELECT part, serial, k FROM ({PEOPLE})")
def merge_all(spark, d):
    return M.merged_all(derived(spark, d, PEOPLE), "part", "serial", ["k"]).select("part", "serial", "k")


@query("merge_part", f"SELECT part AS page_no, serial AS serial_no, k AS row_no FROM ({PEOPLE})")
def merge_part(spark, d):
    p = derived(spark, d, PEOPLE).select(F.col("part").alias("page_no"), F.col("serial").alias("serial_no"), F.col("k").alias("row_no"))
    return M.merged_part(p)


@query(
    "progress_rollup",
    """SELECT r_name AS directory, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 0 END) AS BIGINT) AS records,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS BIGINT) AS pending,
       round_even(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 1) AS pct
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP(r_name)""",
)
def progress_rollup(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    j = j.join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return M.progress(j.select(F.col("r_name").alias("directory"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_custkey").alias("n_records")))


@query("bag_union", "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, '' FROM supplier")
def bag_union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return M.bag_union([a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))])


@query("directory_union", "SELECT c_nationkey AS ac FROM customer UNION SELECT s_nationkey FROM supplier ORDER BY ac")
def directory_union(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("ac")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("ac"))
    return M.set_union(a, b).orderBy("ac")


@query(
    "disk_state",
    """SELECT k, pending, CASE WHEN free < pending * 51200 THEN 'danger' WHEN free < 2 * pending * 51200 THEN 'warning' ELSE 'ok' END AS state
       FROM (SELECT c_custkey AS k, c_custkey % 60 AS pending, 51200 * (c_custkey % 97) AS free FROM customer)""",
)
def disk_state(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 60).alias("pending"), (51200 * (F.col("c_custkey") % 97)).alias("free"))
    return c.select("k", "pending", M.disk_state(F.col("free"), F.col("pending")).alias("state"))


@query(
    "run_summary",
    """SELECT o_orderpriority AS directory, count(*) AS total_pairs, count_if(o_orderstatus = 'F') AS processed, min(o_orderdate) AS started, max(o_orderdate) AS completed,
       arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_run FROM orders GROUP BY o_orderpriority""",
)
def run_summary(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("directory")).agg(
        F.count("*").alias("total_pairs"), F.count_if(F.col("o_orderstatus") == "F").alias("processed"), F.min("o_orderdate").alias("started"),
        F.max("o_orderdate").alias("completed"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_run"),
    )


# ---------------------------------------------------------------- quality

_FIELDS = ["src", "lang", "quality", "toxic"]


@query(
    "fill_rate_long",
    "SELECT field, CAST(sum(CASE WHEN trim(v) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS filled, count(*) AS total,"
    " round_even(sum(CASE WHEN trim(v) <> '' THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 1) AS pct FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS v FROM ({DOCS})" for f in _FIELDS)
    + ") GROUP BY field",
)
def fill_rate_long(spark, d):
    return Q.fill_rates(derived(spark, d, DOCS), _FIELDS)


_CELLS = " + ".join(f"CASE WHEN trim({f}) <> '' THEN 1 ELSE 0 END" for f in _FIELDS)


@query(
    "core_rate",
    f"""SELECT lang, CAST(sum({_CELLS}) AS BIGINT) AS filled, count(*) * 4 AS cells, round_even(sum({_CELLS}) * 100.0::DOUBLE / (count(*) * 4), 1) AS pct
        FROM ({DOCS}) GROUP BY lang""",
)
def core_rate(spark, d):
    return Q.core_rate(derived(spark, d, DOCS), _FIELDS, ["lang"])


_PCT = "round_even(sum(CASE WHEN %s THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 1)"
_ISSUES = {
    "id_empty": STRIP % "raw_id" + " = ''", "id_malformed": f"{STRIP % 'raw_id'} <> '' AND NOT {VALID % (STRIP % 'raw_id')}",
    "name_en_blank": STRIP % "name" + " = ''", "name_ta_blank": STRIP % "rel" + " = ''", "rel_en_blank": STRIP % "rel" + " = ''",
    "rel_ta_blank": STRIP % "serial" + " = ''", "age_blank": STRIP % "age" + " = ''", "gender_blank": STRIP % "sex" + " = ''", "house_blank": STRIP % "house" + " = ''",
    "name_ta_contaminated": f"{STRIP % 'rel'} <> ''", "rel_ta_contaminated": f"{STRIP % 'serial'} <> ''",
}


@query(
    "issue_counts",
    "SELECT part, count(*) AS total, "
    + ", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {k}, {_PCT % c} AS {k}_pct" for k, c in _ISSUES.items())
    + f" FROM ({PEOPLE}) GROUP BY part",
)
def issue_counts(spark, d):
    cols = {"epic": "raw_id", "name_en": "name", "name_ta": "rel", "rel_en": "rel", "rel_ta": "serial", "age": "age", "gender": "sex", "house": "house"}
    return Q.issue_counts(derived(spark, d, PEOPLE), Q.standard_issues(cols), ["part"])


_WHOLE = " AND ".join(f"trim({f}) <> ''" for f in _FIELDS)


@query(
    "complete_rows",
    f"""SELECT lang, count(*) AS total, CAST(sum(CASE WHEN {_WHOLE} THEN 1 ELSE 0 END) AS BIGINT) AS complete,
        round_even(sum(CASE WHEN {_WHOLE} THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 1) AS pct FROM ({DOCS}) GROUP BY ROLLUP(lang)""",
)
def complete_rows(spark, d):
    return Q.complete_rows(derived(spark, d, DOCS), _FIELDS, ["lang"])


@query(
    "distinct_values",
    f"""WITH v AS (SELECT DISTINCT 'src' AS field, src AS value FROM ({DOCS}) UNION SELECT 'lang', lang FROM ({DOCS}) UNION SELECT 'quality', quality FROM ({DOCS}))
        SELECT field, value FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY value) AS n FROM v) WHERE field <> 'src' OR n <= 15""",
)
def distinct_values(spark, d):
    return Q.distinct_values(derived(spark, d, DOCS), ["src", "lang", "quality"], {"src": 15})


@query(
    "bounded_samples",
    f"""SELECT part, list(raw_id ORDER BY k) FILTER (WHERE n <= 10) AS sample, count(*) AS n_all FROM (
        SELECT part, k, raw_id, row_number() OVER (PARTITION BY part ORDER BY k) AS n FROM ({PEOPLE})
        WHERE raw_id <> '' AND NOT {VALID % 'raw_id'}) GROUP BY part""",
)
def bounded_samples(spark, d):
    bad = F.when((F.col("raw_id") != "") & ~T.is_valid_id(F.col("raw_id")), F.col("raw_id"))
    return Q.samples(derived(spark, d, PEOPLE), bad, ["k"], ["part"], 10)


_RULES = {
    "unexpected_gender": ("sex", "sex NOT IN ('Male', 'Female')"), "unexpected_relation_type": ("rel", "rel NOT IN ('Father', 'Husband', 'Mother', 'Other')"),
    "serial_not_numeric": ("serial", "NOT regexp_matches(serial, '^[0-9]+$')"),
    "age_out_of_range": ("age", "regexp_matches(age, '^[0-9]{1,9}$') AND NOT (try_cast(age AS INT) BETWEEN 18 AND 120)"),
    "age_non_numeric": ("age", "NOT regexp_matches(age, '^[0-9]{1,9}$')"), "house_only_apostrophe": ("house", "house = ''''"),
    "english_name_non_ascii": ("name", r"regexp_matches(name, '[^\x00-\x7F]')"), "rel_name_en_non_ascii": ("rel", r"regexp_matches(rel, '[^\x00-\x7F]')"),
    "epic_unknown_prefix": ("epic", VALID % "epic" + " AND substring(epic, 1, 3) NOT IN ('RVJ', 'MDJ', 'IOD', 'JOD')"),
    "part_not_numeric": ("part", "NOT regexp_matches(part, '^[0-9]+$')"), "ac_not_numeric": ("part", "NOT regexp_matches(part, '^[0-9]+$')"),
    "tamil_name_all_ascii": ("name", r"NOT regexp_matches(name, '[^\x00-\x7F]')"), "tamil_rel_all_ascii": ("rel", r"NOT regexp_matches(rel, '[^\x00-\x7F]')"),
    "english_name_very_short": ("name", "length(name) <= 2"), "tamil_name_very_short": ("name", "length(name) <= 3"),
    "house_very_long": ("house", "length(ltrim(house, '''')) > 20"), "english_name_digits_only": ("name", "regexp_matches(replace(name, ' ', ''), '^[0-9]+$')"),
    "english_name_looks_like_epic": ("name", VALID % "replace(name, ' ', '')"),
    "house_number_suspiciously_large": ("house", "regexp_matches(ltrim(house, ''''), '^[0-9]{5,}$')"),
    "part_out_of_range": ("part", "regexp_matches(part, '^[0-9]{1,9}$') AND NOT (try_cast(part AS INT) BETWEEN 1 AND 400)"),
}
_ANOMALY_ROWS = """SELECT k, CAST(part AS VARCHAR(20)) AS part, trim(raw_id) AS epic, trim(name) AS name, trim(rel) AS rel, trim(age) AS age, trim(sex) AS sex, trim(house) AS house, trim(serial) AS serial FROM (%s) p"""


@query(
    "anomaly_scan",
    "WITH r AS (" + _ANOMALY_ROWS % PEOPLE + "), h AS ("
    + " UNION ALL ".join(f"SELECT k, '{t}' AS type, '''' || substr({c}, 1, 40) || '''' AS detail FROM r WHERE {c} <> '' AND {w}" for t, (c, w) in _RULES.items())
    + ") SELECT type, count(*) AS n, list_slice(list(detail ORDER BY k, detail), 1, 5) AS sample FROM h GROUP BY type",
)
def anomaly_scan(spark, d):
    cols = {"gender": "sex", "rel_type": "rel", "serial": "serial", "age": "age", "house": "house", "name_en": "name", "rel_en": "rel", "epic": "epic", "part": "part",
            "ac": "part", "name_ta": "name", "rel_ta": "rel"}
    rules = Q.anomaly_rules(cols, ["RVJ", "MDJ", "IOD", "JOD"], ["Father", "Husband", "Mother", "Other"])
    return Q.anomalies(derived(spark, d, _ANOMALY_ROWS % PEOPLE), rules, ["k"])


@query(
    "file_issues",
    """SELECT ac, n_first, n_second, list_filter([CASE WHEN n_first = 0 THEN 'no first-language files' END, CASE WHEN n_second = 0 THEN 'no second-language files' END,
       CASE WHEN n_first > 0 AND n_second > 0 AND n_first <> n_second THEN 'file counts differ: ' || n_first || ' vs ' || n_second END], lambda x: x IS NOT NULL) AS issues
       FROM (SELECT o_custkey AS ac, count_if(o_orderstatus = 'F') AS n_first, count_if(o_orderstatus = 'O') AS n_second FROM orders GROUP BY o_custkey)""",
)
def file_issues(spark, d):
    n = lambda s, a: F.count_if(F.col("o_orderstatus") == s).alias(a)
    return Q.file_issues(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ac")).agg(n("F", "n_first"), n("O", "n_second")))


# ---------------------------------------------------------------- predicates and texts


@query(
    "nondata_pages",
    r"""SELECT doc_id, (upper(text) LIKE '%SUMMARY OF ELECTORS%' OR (upper(text) LIKE '%SUMMARY%' AND upper(text) LIKE '%TOTAL%') OR text LIKE '%E- Expired%'
        OR text LIKE '%S- Shifted%' OR (text LIKE '%Expired%' AND text LIKE '%Shifted%' AND text LIKE '%Repeated%') OR upper(text) LIKE '%ELECTORAL ROLL%'
        OR (text LIKE '%வாக்காளர்%' AND text LIKE '%பட்டியல்%') OR upper(text) LIKE '%NAZRI NAKSHA%' OR upper(text) LIKE '%GOOGLE MAP VIEW%'
        OR upper(text) LIKE '%POLLING STATION BUILDING%' OR (upper(text) LIKE '%KEY MAP VIEW%' AND upper(text) LIKE '%CAD VIEW%')
        OR (length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 100 AND text LIKE '%கையொப்பம்%') OR length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 50) AS non_data FROM documents""",
)
def nondata_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_non_data_page(F.col("text")).alias("non_data"))


@query(
    "page_split",
    r"""SELECT doc_id, CAST(page_no AS INT) AS page_no, page_text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS page_text,
        generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents) WHERE page_no > 1""",
)
def page_split(spark, d):
    return S.split_pages(table(spark, d, "documents").select("doc_id", "text"), separator="\n", skip_pages=1).drop("text")


@query(
    "artefact_lines",
    r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM documents)
        SELECT doc_id, len(list_filter(list_transform(list_filter(ls, lambda x: lower(x) NOT IN ('', 'available', 'photo', 'photo available', 'photo is available')),
        lambda x: regexp_replace(regexp_replace(x, '(?i)\s*photo\s*$', ''), '(?i)\s*available\s*$', '')), lambda x: x <> '')) AS n_lines FROM l""",
)
def artefact_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.without_artefacts(F.split("text", "\n"))).cast("long").alias("n_lines"))


#: second-language names as they are read: whole, too short, a label, with signs of the first language, or not at all
SCRIPT = """SELECT k, CASE k % 7 WHEN 0 THEN 'ஆஷா ராணி' WHEN 1 THEN 'ஆண்' WHEN 2 THEN 'ர' WHEN 3 THEN concat('ரவி ', name) WHEN 4 THEN name WHEN 5 THEN ' பாலினம் ' ELSE '' END AS text
  FROM (SELECT c_custkey AS k, c_name AS name FROM customer) c"""


@query(
    "script_counts",
    rf"""SELECT k, length(regexp_replace(text, '[^\x{{0B80}}-\x{{0BFF}}]', '', 'g')) AS n_script,
        length(regexp_replace(text, '[^\x{{0B80}}-\x{{0BFF}}]', '', 'g')) >= 3 AND trim(text) NOT IN ({', '.join(f"'{w}'" for w in (*T.GENDER_LABELS, *T.NOISE_WORDS))}) AS is_name,
        regexp_matches(text, '[A-Za-z0-9!@#$%^&*()+={{}};:''",.<>/?\\|`~\-]') AS contaminated FROM ({SCRIPT})""",
)
def script_counts(spark, d):
    t = F.col("text")
    return derived(spark, d, SCRIPT).select(
        "k", T.script_chars(t).cast("long").alias("n_script"), T.is_second_script_name(t).alias("is_name"), T.is_contaminated(t).alias("contaminated")
    )


@query(
    "clean_second_script",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
        a AS (SELECT doc_id, n, regexp_replace(regexp_replace(regexp_replace(x, '^.*பெயர்\s*[:：]?\s*', ''), '^[\s:.\-|]+', ''), '^\s+|\s+$', '', 'g') AS s FROM l)
        SELECT doc_id, n AS line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '-+$', ''), '\s+$', ''), '[\x00-\x1F!-&(-,/-\x7F]', '', 'g'), '\s{2,}', ' ', 'g'),
               '^[ .''\-]+|[ .''\-]+$', '', 'g') AS cleaned FROM a""",
)
def clean_second_script(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("_p", "x"))
    return lines.select("doc_id", (F.col("_p") + 1).cast("long").alias("line_no"), T.clean_second_script(F.col("x")).alias("cleaned"))


_UP = r"regexp_replace(regexp_replace(upper(replace(raw_id, ' ', '')), '^[^A-Z0-9]+', ''), '[^A-Z0-9]+$', '')"
_HEAD, _TAIL = "translate(substr(u, 1, 3), '01586', 'OISBG')", "translate(substr(u, 4, 7), 'OILSBGZDTQ', '0115862079')"
FIXED = f"""SELECT k, raw_id, CASE WHEN length(u) < 9 THEN u WHEN regexp_matches({_HEAD} || {_TAIL}, '^[A-Z]{{3}}[0-9]{{6}}$') THEN {_HEAD} || '0' || {_TAIL}
   ELSE {_HEAD} || {_TAIL} END AS epic_id FROM (SELECT k, raw_id, {_UP} AS u FROM ({PEOPLE}))"""


@query("id_repair", FIXED)
def id_repair(spark, d):
    return derived(spark, d, PEOPLE).select("k", "raw_id", T.fix_id(F.col("raw_id")).alias("epic_id"))


def _repaired(spark, d) -> DataFrame:
    return derived(spark, d, PEOPLE).select("k", T.fix_id(F.col("raw_id")).alias("epic_id"))


_FREQ = f"SELECT substr(epic_id, 1, 3) AS prefix, count(*) AS n FROM ({FIXED}) WHERE {VALID % 'epic_id'} GROUP BY 1"


@query("id_prefix_frequency", _FREQ)
def id_prefix_frequency(spark, d):
    return V.prefix_frequency(_repaired(spark, d))


@query("top_prefixes", _FREQ + " ORDER BY n DESC, prefix LIMIT 5")
def top_prefixes(spark, d):
    return V.prefix_frequency(_repaired(spark, d)).orderBy(F.col("n").desc(), "prefix").limit(5)


@query(
    "prefix_recovery",
    f"""WITH f AS ({_FREQ}), c AS (SELECT substr(prefix, 2, 2) AS two, 0 AS kind, prefix, n FROM f UNION ALL SELECT substr(prefix, 1, 2), 1, prefix, n FROM f),
        g AS (SELECT two, kind, sum(n) AS total, arg_max(prefix, (n, prefix)) AS prefix, max(n) AS n FROM c GROUP BY two, kind),
        b AS (SELECT *, row_number() OVER (PARTITION BY two ORDER BY kind) AS r FROM g)
        SELECT two, prefix FROM b WHERE r = 1 AND n / total >= 0.8 AND n >= 5""",
)
def prefix_recovery(spark, d):
    return V.recovered_prefixes(V.prefix_frequency(_repaired(spark, d)))


_H1 = r"regexp_replace(trim(regexp_replace(regexp_replace(house, '[^a-zA-Z0-9\-/() ]', '', 'g'), '\s{2,}', ' ', 'g')), '^[\-/ ]+|[\-/ ]+$', '', 'g')"


@query(
    "house_clean",
    rf"""WITH a AS (SELECT k, house, {_H1} AS s FROM ({PEOPLE})),
        b AS (SELECT k, house, CASE WHEN strpos(s, ')') = 0 THEN replace(s, '(', '') ELSE s END AS s FROM a),
        c AS (SELECT k, house, CASE WHEN strpos(s, '(') = 0 THEN replace(s, ')', '') ELSE s END AS s FROM b)
        SELECT k, house, CASE WHEN regexp_matches(s, '^[0-9]{{5,}}$') THEN '' WHEN regexp_matches(s, '^[SOIBGZTsoibgzt]\s*[0-9]')
          THEN translate(upper(substr(s, 1, 1)), 'SOIBGZT', '5018627') || regexp_replace(s, '^[A-Za-z]\s*', '') ELSE s END AS cleaned,
        CASE WHEN house <> '' AND house NOT LIKE '''%' THEN '''' || house ELSE house END AS guarded FROM c""",
)
def house_clean(spark, d):
    h = F.col("house")
    return derived(spark, d, PEOPLE).select("k", "house", T.clean_house(h).alias("cleaned"), T.guarded(h).alias("guarded"))


@query("range_filter", f"SELECT k, part FROM ({PEOPLE}) WHERE part IN (1, 5) OR part BETWEEN 10 AND 20")
def range_filter(spark, d):
    p = derived(spark, d, PEOPLE).select("k", "part", F.col("part").alias("part_no"))
    return I.selected(p, parts="1,5,10-20,9-3").select("k", "part")


@query(
    "valid_records",
    f"""SELECT k, (CASE WHEN length({STRIP % 'name'}) >= 3 THEN 1 ELSE 0 END + CASE WHEN {VALID % 'raw_id'} THEN 1 ELSE 0 END + CASE WHEN trim(serial) <> '' THEN 1 ELSE 0 END
        + CASE WHEN trim(age) <> '' AND trim(sex) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(house) <> '' THEN 1 ELSE 0 END) >= 2 AS valid FROM ({PEOPLE})""",
)
def valid_records(spark, d):
    c = F.col
    return derived(spark, d, PEOPLE).select("k", T.is_valid_record(c("name"), c("raw_id"), c("serial"), c("age"), c("sex"), c("house")).alias("valid"))


@query(
    "normalised_fields",
    f"""SELECT k, CASE WHEN lower(rel) LIKE 'fat%' OR lower(rel) LIKE 'fal%' THEN 'Father' WHEN lower(rel) LIKE 'hus%' THEN 'Husband' WHEN lower(rel) LIKE 'moth%' THEN 'Mother'
        ELSE upper(substr(rel, 1, 1)) || lower(substr(rel, 2)) END AS relation, CASE WHEN lower(sex) LIKE 'ma%' THEN 'Male' WHEN lower(sex) LIKE 'fe%' THEN 'Female' ELSE sex END AS gender,
        regexp_replace(regexp_replace(regexp_replace(name, '[^\\p{{L}} .''\\-]', '', 'g'), '\\s{{2,}}', ' ', 'g'), '^[ .''\\-]+|[ .''\\-]+$', '', 'g') AS name FROM ({PEOPLE})""",
)
def normalised_fields(spark, d):
    return derived(spark, d, PEOPLE).select(
        "k", T.relation_type(F.col("rel")).alias("relation"), T.gender(F.col("sex")).alias("gender"), T.clean_name(F.col("name")).alias("name")
    )


@query(
    "record_warnings",
    f"""SELECT k, list_filter([CASE WHEN epic <> '' AND NOT {VALID % 'epic'} THEN 'invalid id: ' || epic END,
        CASE WHEN age <> '' AND NOT regexp_matches(age, '^[0-9]{{1,9}}$') THEN 'non-numeric age: ' || age END,
        CASE WHEN regexp_matches(age, '^[0-9]{{1,9}}$') AND NOT (try_cast(age AS INT) BETWEEN 18 AND 120) THEN 'age out of range: ' || age END,
        CASE WHEN sex <> '' AND sex NOT IN ('Male', 'Female') THEN 'unexpected gender: ' || sex END], lambda x: x IS NOT NULL) AS warnings
        FROM ({_ANOMALY_ROWS % PEOPLE})""",
)
def record_warnings(spark, d):
    r = derived(spark, d, _ANOMALY_ROWS % PEOPLE)
    return r.select("k", T.validation_warnings(F.col("epic"), F.col("age"), F.col("sex")).alias("warnings"))


@query(
    "log_severity",
    """SELECT event_id, CASE WHEN regexp_matches(l, 'error|failed|exception') THEN 'error' WHEN strpos(l, 'warn') > 0 THEN 'warn' WHEN regexp_matches(l, '\\[ok\\]|success|done') THEN 'ok'
       WHEN l LIKE '[%' OR strpos(l, 'info') > 0 THEN 'info' ELSE '' END AS severity
       FROM (SELECT event_id, lower(CASE WHEN event_id % 5 = 0 THEN 'Failed: ' || event_type WHEN event_id % 5 = 1 THEN '[OK] ' || event_type WHEN event_id % 5 = 2 THEN 'WARNING' WHEN event_id % 5 = 3 THEN '[x]' ELSE event_type END) AS l FROM events)""".replace("\\\\", "\\"),
)
def log_severity(spark, d):
    e, m = table(spark, d, "events"), F.col("event_id") % 5
    line = (
        F.when(m == 0, F.concat(F.lit("Failed: "), "event_type")).when(m == 1, F.concat(F.lit("[OK] "), "event_type")).when(m == 2, "WARNING")
        .when(m == 3, "[x]").otherwise(F.col("event_type"))
    )
    return e.select("event_id", T.log_severity(line).alias("severity"))


@query("log_tail", "SELECT event_id, event_type AS line FROM events ORDER BY event_id DESC LIMIT 500")
def log_tail(spark, d):
    lines = table(spark, d, "events").select("event_id", F.col("event_type").alias("line"))
    return S.tail(lines, ["event_id"]).select("event_id", "line")


@query(
    "newest_preview",
    "SELECT conv_id, turn, role FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations WHERE turn = (SELECT max(turn) FROM conversations)) ORDER BY turn LIMIT 10",
)
def newest_preview(spark, d):
    return S.newest_preview(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", ["turn"])


@query("percentages", "SELECT c_custkey AS k, CASE WHEN c_custkey % 50 > 0 THEN round_even((c_custkey % 17) * 100.0::DOUBLE / (c_custkey % 50), 1) ELSE 0.0 END AS pct FROM customer")
def percentages(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), T.percent(k % 17, k % 50).alias("pct"))


# ---------------------------------------------------------------- parsing

_FILE = """concat(CAST(2000 + o_orderkey % 25 AS VARCHAR(20)), '-EROLLGEN-S', CAST(o_custkey % 30 AS VARCHAR(20)), '-', CAST(o_custkey % 200 AS VARCHAR(20)), '-ab_', o_orderstatus,
  '-FinalRoll-Revision', CAST(o_orderkey % 3 AS VARCHAR(20)), CASE WHEN o_orderkey % 4 = 0 THEN '-TAM-' ELSE '-ENG-' END, CAST(o_custkey % 90 AS VARCHAR(20)), '-WI_page_',
  CAST(o_orderkey % 60 AS VARCHAR(20)), CASE WHEN o_orderkey % 9 = 0 THEN '.txt' ELSE '.pdf' END)"""
NAMES = f"SELECT o_orderkey AS k, {_FILE} AS path FROM orders"


def _name_sql(language: str) -> str:
    rx = S.PAGE_NAME % language
    fields = ", ".join(f"regexp_extract(path, '{rx}', {i + 1}) AS {f}" for i, f in enumerate(S.NAME_FIELDS))
    return f"SELECT k, {fields}, CAST(regexp_extract(path, '{rx}', 7) AS INT) AS page_no FROM ({NAMES}) WHERE regexp_matches(path, '{rx}')"


@query("page_names_first", _name_sql("ENG"))
def page_names_first(spark, d):
    return S.page_metadata(derived(spark, d, NAMES), "ENG").select("k", *S.NAME_FIELDS, "page_no")


@query("page_names_second", _name_sql("TAM"))
def page_names_second(spark, d):
    return S.page_metadata(derived(spark, d, NAMES), "TAM").select("k", *S.NAME_FIELDS, "page_no")


@query(
    "candidate_pairs",
    f"""SELECT a.k, a.ac_no, a.part_no, a.page_no, b.page_no AS other_page, b.k AS other_path FROM ({_name_sql('ENG')}) a
        LEFT JOIN ({_name_sql('TAM')}) b ON a.ac_no = b.ac_no AND a.part_no = b.part_no""",
)
def candidate_pairs(spark, d):
    names, part = derived(spark, d, NAMES), ["ac_no", "part_no"]
    first = S.page_metadata(names, "ENG").select("k", *part, "page_no")
    return J.candidate_pairs(first, S.page_metadata(names, "TAM").select(*part, "page_no", F.col("k").alias("path")), part).select("k", *part, "page_no", "other_page", "other_path")


@query(
    "part_keys",
    rf"""SELECT k, regexp_replace(regexp_replace(file, '\.csv$', ''), '_page_\d+$', '') AS part_key,
        CASE WHEN regexp_matches(file, '_page_\d+(\.csv)?$') THEN CAST(regexp_extract(file, '_page_(\d+)(\.csv)?$', 1) AS INT) END AS page
        FROM (SELECT k, replace(replace(path, '.pdf', '.csv'), '.txt', '') AS file FROM ({NAMES}))""",
)
def part_keys(spark, d):
    files = derived(spark, d, NAMES).select("k", F.replace(F.replace(F.col("path"), F.lit(".pdf"), F.lit(".csv")), F.lit(".txt"), F.lit("")).alias("file"))
    return S.with_page_key(files).select("k", "part_key", "page")


#: cell texts with known fields; a relation label alone on its line gives the end of its own word as the name
CELLS = """SELECT k, concat('= ', CAST(k % 900 AS VARCHAR(20)), ' RVJ', lpad(CAST(k AS VARCHAR(20)), 7, '0'), chr(10), CASE k % 4 WHEN 0 THEN 'Nane : Asha Rani -' WHEN 1 THEN 'Name: Kumar' WHEN 2 THEN 'Narne . Devi P' ELSE 'Nama - Selvam' END, chr(10),
  CASE WHEN k % 2 = 0 THEN 'Fatner Name: Ravi Kumar' ELSE concat('Husband', chr(10), 'Name: Ravi Kumar') END, chr(10), 'Photo', chr(10), 'Hovse Number : ', CAST(k % 99 AS VARCHAR(20)), 'B Photo', chr(10),
  CASE WHEN k % 3 = 0 THEN concat('Age : ', CAST(20 + k % 60 AS VARCHAR(20)), ' Gerder : Male') ELSE concat('Ago = ', CAST(20 + k % 60 AS VARCHAR(20)), chr(10), 'Gender : Female Available') END) AS text
  FROM (SELECT c_custkey AS k FROM customer) c"""


@query(
    "parse_cells",
    """SELECT c_custkey AS k, CAST(c_custkey % 900 AS VARCHAR) AS serial_no, 'RVJ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS epic_id,
       CASE c_custkey % 4 WHEN 0 THEN 'Asha Rani' WHEN 1 THEN 'Kumar' WHEN 2 THEN 'Devi P' ELSE 'Selvam' END AS name_english,
       CASE WHEN c_custkey % 2 = 0 THEN 'Ravi Kumar' ELSE 'and' END AS relation_name_english, CASE WHEN c_custkey % 2 = 0 THEN 'Father' ELSE 'Husband' END AS relation_type, CAST(c_custkey % 99 AS VARCHAR) || 'B' AS house_no,
       CAST(20 + c_custkey % 60 AS VARCHAR) AS age, CASE WHEN c_custkey % 3 = 0 THEN 'Male' ELSE 'Female' END AS gender FROM customer""",
)
def parse_cells(spark, d):
    return derived(spark, d, CELLS).select("k", P.parse_first_language(F.col("text")).alias("r")).select("k", "r.*")


@query("cell_ids", "SELECT c_custkey AS k, 'RVJ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS epic_id FROM customer")
def cell_ids(spark, d):
    return derived(spark, d, CELLS).select("k", T.id_in_text(F.col("text")).alias("epic_id"))


@query(
    "parse_second_cells",
    """SELECT c_custkey AS k, CAST(c_custkey % 900 AS VARCHAR) AS serial_no, CASE c_custkey % 4 WHEN 0 THEN 'ஆஷா ராணி' WHEN 1 THEN 'செல்வம்' WHEN 2 THEN 'தேவி' ELSE 'குமார் ப' END AS name_tamil,
       CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'ரவி குமார்' END AS relation_name_tamil FROM customer""",
)
def parse_second_cells(spark, d):
    k = F.col("c_custkey")
    label = F.when(k % 3 == 0, "தந்தையின் பெயர் : ரவி குமார் -").when(k % 3 == 1, "xx பெயர: ரவி குமார் 12").otherwise("பாலினம் : ஆண்")
    name = F.when(k % 4 == 0, "ஆஷா ab ராணி -").when(k % 4 == 1, "செல்வம்").when(k % 4 == 2, "தேவி 12").otherwise("குமார்  ப")
    text = F.concat(k % 900, F.lit("\nபெயர் : "), name, F.lit("\n"), label, F.lit("\nphoto available"))
    return table(spark, d, "customer").select(k.alias("k"), P.parse_second_language(text).alias("r")).select("k", "r.*")


@query(
    "html_fields",
    r"""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, 'lang="(\w+)"', 1) AS lang FROM pages""",
)
def html_fields(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", r'lang="(\w+)"', 1).alias("lang"))


# ---------------------------------------------------------------- sequences

_INFER = """SELECT page, cell_index, serial, coalesce(serial, last_value(off IGNORE NULLS) OVER (PARTITION BY page ORDER BY cell_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + pos,
  first_value(off IGNORE NULLS) OVER (PARTITION BY page ORDER BY cell_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) + pos) AS inferred
  FROM (SELECT *, cell_index + 1 AS pos, serial - (cell_index + 1) AS off FROM (%s))"""


@query("serial_inference", _INFER % REC)
def serial_inference(spark, d):
    return W.infer_serials(derived(spark, d, REC), ["page"], ["cell_index"]).select("page", "cell_index", "serial", "inferred")


_RUN = f"""SELECT page, arg_max(start, (n, -start)) AS run_start, max(n) AS run_length FROM (
  SELECT page, g, min(serial) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY serial ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN serial = lag(serial) OVER (PARTITION BY page ORDER BY serial) + 1 THEN 0 ELSE 1 END AS new FROM ({REC}) WHERE serial IS NOT NULL)) GROUP BY page, g) GROUP BY page"""


@query("longest_run", _RUN)
def longest_run(spark, d):
    return W.longest_run(derived(spark, d, REC), ["page"])


_CONFUSE = "WITH m(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in T.DIGIT_CONFUSIONS.items() for b in bs) + ")"


@query(
    "confusion_candidates",
    _CONFUSE
    + """, v AS (SELECT c_custkey AS k, c_custkey AS n, (c_custkey // 50) * 50 AS low, (c_custkey // 50) * 50 + 30 AS high FROM customer),
      x AS (SELECT k, low, high, unnest(string_split(CAST(n AS VARCHAR), '')) AS ch, generate_subscripts(string_split(CAST(n AS VARCHAR), ''), 1) AS i, CAST(n AS VARCHAR) AS s FROM v),
      c AS (SELECT DISTINCT k, CAST(substr(s, 1, i - 1) || b || substr(s, i + 1) AS BIGINT) AS y, low, high FROM x JOIN m ON m.a = x.ch),
      o AS (SELECT k, min(y) AS y FROM c WHERE y BETWEEN low AND high GROUP BY k HAVING count(*) = 1)
      SELECT v.k, o.y AS corrected FROM v LEFT JOIN o USING (k)""",
)
def confusion_candidates(spark, d):
    k = F.col("c_custkey")
    low = F.floor(k / 50) * 50
    return table(spark, d, "customer").select(k.alias("k"), T.corrected_serial(k, low, low + 30).alias("corrected"))


@query(
    "stray_correction",
    _CONFUSE
    + f""", r AS ({REC}), z AS (SELECT page, count(*) AS n_rows, count(serial) AS known FROM r GROUP BY page), run AS ({_RUN}),
      j AS (SELECT r.*, run_start + run_length // 2 AS anchor, greatest(n_rows + 5, 20) AS reach, n_rows, known FROM r JOIN z USING (page) LEFT JOIN run USING (page)),
      s AS (SELECT *, coalesce(n_rows >= 3 AND known >= 3 AND serial IS NOT NULL AND serial <> 0 AND NOT (serial BETWEEN anchor - reach AND anchor + reach), false) AS stray FROM j),
      x AS (SELECT page, cell_index, anchor, reach, CAST(serial AS VARCHAR) AS t, unnest(string_split(CAST(serial AS VARCHAR), '')) AS ch,
            generate_subscripts(string_split(CAST(serial AS VARCHAR), ''), 1) AS i FROM s WHERE stray),
      c AS (SELECT DISTINCT page, cell_index, CAST(substr(t, 1, i - 1) || b || substr(t, i + 1) AS BIGINT) AS y, anchor, reach FROM x JOIN m ON m.a = x.ch),
      o AS (SELECT page, cell_index, min(y) AS y FROM c WHERE y BETWEEN anchor - reach AND anchor + reach GROUP BY page, cell_index HAVING count(*) = 1),
      f AS (SELECT s.page, s.cell_index, s.serial, CASE WHEN stray THEN o.y ELSE s.serial END AS fixed, bool_or(stray) OVER (PARTITION BY s.page) AS changed
            FROM s LEFT JOIN o ON o.page = s.page AND o.cell_index = s.cell_index),
      q AS (SELECT *, cell_index + 1 AS pos, fixed - (cell_index + 1) AS off FROM f)
      SELECT page, cell_index, serial, CASE WHEN changed THEN coalesce(fixed,
        last_value(off IGNORE NULLS) OVER (PARTITION BY page ORDER BY cell_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + pos,
        first_value(off IGNORE NULLS) OVER (PARTITION BY page ORDER BY cell_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) + pos) ELSE fixed END AS corrected FROM q""",
)
def stray_correction(spark, d):
    return W.correct_strays(derived(spark, d, REC), ["page"], ["cell_index"]).select("page", "cell_index", "serial", "corrected")


@query(
    "serial_gaps",
    f"""WITH s AS (SELECT page, serial, lead(serial) OVER (PARTITION BY page ORDER BY serial) AS nxt, greatest(count(*) OVER (PARTITION BY page) + 5, 20) AS reach
          FROM ({DUP}) WHERE serial IS NOT NULL),
        m AS (SELECT *, greatest(coalesce(nxt - serial - 1, 0), 0) AS n FROM s)
        SELECT page, list_sort(flatten(list(CASE WHEN n BETWEEN 1 AND reach THEN range(serial + 1, nxt) ELSE [] END))) AS gaps, CAST(sum(n) AS BIGINT) AS n_missing FROM m GROUP BY page""",
)
def serial_gaps(spark, d):
    return W.serial_gaps(derived(spark, d, DUP), ["page"])


@query(
    "duplicate_repair",
    f"""WITH RECURSIVE p AS (SELECT page, list(serial ORDER BY cell_index) AS vs FROM ({DUP}) GROUP BY page),
        k AS (SELECT page, vs, list_distinct(list_filter(vs, lambda x: x IS NOT NULL)) AS taken,
              list_filter(vs, lambda x, i: x IS NOT NULL AND list_position(vs, x) = i AND len(list_filter(vs, lambda y: y = x)) > 1) AS dups FROM p),
        fold AS (
          SELECT page, vs, vs AS now, taken, dups, 1 AS step, list_min(taken) AS low, list_max(taken) AS high FROM k
          UNION ALL
          SELECT page, vs, CASE WHEN g IS NOT NULL THEN list_transform(now, lambda x, i: CASE WHEN i = chosen THEN g ELSE x END)
              ELSE list_transform(cleared, lambda x, i: coalesce(x, cleared[coalesce(list_max(list_filter(held, lambda h: h < i)), held[1])] + i - coalesce(list_max(list_filter(held, lambda h: h < i)), held[1]))) END,
            CASE WHEN g IS NOT NULL THEN list_append(taken, g) ELSE taken END, dups, step + 1, low, high
          FROM (SELECT *, list_sort(list_transform(spots, lambda i: [abs(i - 1 - (g - low)), i]))[1][2] AS chosen, list_filter(range(1, len(cleared) + 1), lambda i: cleared[i] IS NOT NULL) AS held
            FROM (SELECT *, CASE WHEN below > low AND NOT (coalesce(above < high, false) AND above - v < v - below) THEN below WHEN above < high THEN above END AS g,
                    list_transform(now, lambda x, i: CASE WHEN vs[i] = v AND i > spots[1] THEN NULL ELSE x END) AS cleared
              FROM (SELECT *, list_max(list_filter(taken, lambda x: x <= v AND NOT list_contains(taken, x - 1))) - 1 AS below,
                      list_min(list_filter(taken, lambda x: x >= v AND NOT list_contains(taken, x + 1))) + 1 AS above,
                      list_filter(range(1, len(vs) + 1), lambda i: vs[i] = v) AS spots
                FROM (SELECT *, dups[step] AS v FROM fold WHERE step <= len(dups)))))),
        done AS (SELECT * FROM fold WHERE step = len(dups) + 1)
        SELECT page, generate_subscripts(vs, 1) - 1 AS cell_index, unnest(vs) AS serial, unnest(now) AS repaired FROM done""",
)
def duplicate_repair(spark, d):
    return W.repair_duplicates(derived(spark, d, DUP), ["page"], ["cell_index"]).select("page", "cell_index", "serial", "repaired")


@query("cell_positions", f"SELECT page, cell_index, CAST(cell_index // 3 AS INT) AS grid_row, CAST(cell_index % 3 AS INT) AS grid_col FROM ({REC})")
def cell_positions(spark, d):
    p = W.cell_position(F.col("cell_index"))
    return derived(spark, d, REC).select("page", "cell_index", p["row"].alias("grid_row"), p["col"].alias("grid_col"))


@query("odd_pages", "SELECT l_suppkey AS page, count(*) AS n_records FROM lineitem GROUP BY l_suppkey HAVING NOT count(*) BETWEEN 560 AND 620")
def odd_pages(spark, d):
    return W.odd_pages(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page")), ["page"], 560, 620)


@query(
    "trailing_rows",
    f"""SELECT page, cell_index, serial FROM (SELECT *, max(CASE WHEN serial IS NOT NULL THEN cell_index // 3 END) OVER (PARTITION BY page) AS last FROM ({REC}))
        WHERE cell_index // 3 <= last""",
)
def trailing_rows(spark, d):
    return W.trim_trailing(derived(spark, d, REC), ["page"], "cell_index", F.col("serial").isNotNull()).select("page", "cell_index", "serial")


# ---------------------------------------------------------------- votes


@query(
    "majority_vote",
    f"""WITH r AS ({READINGS}), c AS (SELECT page, cell, value, count(*) AS n, min(reader_ord) AS o FROM r WHERE value <> '' GROUP BY page, cell, value),
        b AS (SELECT page, cell, arg_max(value, (CASE WHEN n >= 2 THEN n ELSE 0 END, -o)) AS voted FROM c GROUP BY page, cell)
        SELECT DISTINCT r.page, r.cell, coalesce(b.voted, '') AS voted FROM r LEFT JOIN b ON b.page = r.page AND b.cell = r.cell""",
)
def majority_vote(spark, d):
    return V.majority(derived(spark, d, READINGS), ["page", "cell"])


_VOTE = f"""WITH r AS ({READINGS}), c AS (SELECT page, cell, value, count(*) AS n, max(confidence) AS c, min(reader_ord) AS o FROM r WHERE {VALID % 'value'} GROUP BY page, cell, value),
  b AS (SELECT page, cell, arg_max(value, (n >= 2, CASE WHEN n >= 2 THEN n ELSE 0 END, c, -o)) AS voted,
        arg_max(CASE WHEN n >= 2 THEN least(c + 10, 100.0) ELSE c END, (n >= 2, CASE WHEN n >= 2 THEN n ELSE 0 END, c, -o)) AS conf FROM c GROUP BY page, cell),
  v AS (SELECT DISTINCT r.page, r.cell, coalesce(b.voted, '') AS voted, coalesce(b.conf, 0.0) AS voted_confidence FROM r LEFT JOIN b ON b.page = r.page AND b.cell = r.cell)"""


@query("confidence_vote", _VOTE + " SELECT * FROM v")
def confidence_vote(spark, d):
    return V.confidence_vote(derived(spark, d, READINGS), ["page", "cell"])


_EPIC = "CASE WHEN cell % 6 = 0 THEN '' WHEN cell % 6 = 1 THEN 'X1' ELSE 'RVJ' || lpad(CAST(cell AS VARCHAR), 7, '0') END"


@query(
    "id_decision",
    _VOTE
    + f""", e AS (SELECT *, {_EPIC} AS epic0 FROM v)
      SELECT page, cell, CASE WHEN (epic0 = '' AND voted <> '') OR ({VALID % 'epic0'} AND voted <> '' AND voted <> epic0 AND voted_confidence >= 70) THEN voted ELSE epic0 END AS epic,
      CASE WHEN epic0 = '' AND voted <> '' THEN voted_confidence WHEN {VALID % 'epic0'} AND voted <> '' THEN voted_confidence WHEN {VALID % 'epic0'} THEN 50.0 ELSE 100.0 END AS confidence FROM e""",
)
def id_decision(spark, d):
    v = V.confidence_vote(derived(spark, d, READINGS), ["page", "cell"])
    c = F.col("cell")
    epic = F.when(c % 6 == 0, "").when(c % 6 == 1, "X1").otherwise(F.concat(F.lit("RVJ"), F.lpad(c.cast("string"), 7, "0")))
    return v.select("page", "cell", V.decide_id(epic, F.col("voted"), F.col("voted_confidence")).alias("r")).select("page", "cell", "r.*")


@query(
    "fallback_chain",
    f"""WITH g AS (SELECT page, cell, list(value ORDER BY reader_ord) AS vs FROM ({READINGS}) GROUP BY page, cell)
        SELECT page, cell, coalesce(list_filter(vs, lambda x: {VALID % 'x'} AND x LIKE '%7')[1], list_filter(vs, lambda x: length(x) = list_max(list_transform(vs, lambda y: length(y))))[1]) AS chosen FROM g""",
)
def fallback_chain(spark, d):
    g = derived(spark, d, READINGS).groupBy("page", "cell").agg(F.array_sort(F.collect_list(F.struct("reader_ord", "value"))).alias("vs"))
    good = lambda x: x.rlike(T.VALID_ID) & x.endswith("7")
    return g.select("page", "cell", V.first_good(F.transform("vs", lambda s: s["value"]), good).alias("chosen"))


# ---------------------------------------------------------------- matching

_OVERLAP = f"""SELECT part_no, page, other_page, least(count(DISTINCT cell_index), 3) AS score FROM (SELECT DISTINCT part_no, page_no AS page, epic_id FROM ({EN})) e
  JOIN (SELECT part_no, page_no AS other_page, cell_index, epic_id FROM ({TA}) WHERE cell_index < 6) t USING (part_no, epic_id) GROUP BY part_no, page, other_page"""


@query("page_overlap", _OVERLAP)
def page_overlap(spark, d):
    return J.page_overlap(derived(spark, d, EN), derived(spark, d, TA))


@query(
    "best_page",
    f"""WITH s AS ({_OVERLAP}), c AS (SELECT DISTINCT e.part_no, e.page, t.other_page FROM (SELECT DISTINCT part_no, page_no AS page FROM ({EN})) e
          JOIN (SELECT DISTINCT part_no, page_no AS other_page FROM ({TA})) t USING (part_no)),
        x AS (SELECT c.*, coalesce(score, 0) AS score, c.other_page - c.page AS away FROM c LEFT JOIN s ON s.part_no = c.part_no AND s.page = c.page AND s.other_page = c.other_page),
        y AS (SELECT *, CASE away WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN -1 THEN 2 END AS near FROM x),
        z AS (SELECT *, CASE WHEN near IS NOT NULL AND score >= 2 THEN 1 WHEN near IS NOT NULL AND score >= 1 THEN 2 WHEN near IS NULL AND score >= 1 THEN 3 WHEN away = 1 THEN 4 WHEN away = 0 THEN 5 END AS tier FROM y)
        SELECT part_no, page, arg_min(other_page, (tier, CASE WHEN tier <= 2 THEN near WHEN tier = 3 THEN other_page ELSE 0 END)) AS best_other FROM z WHERE tier IS NOT NULL GROUP BY part_no, page""",
)
def best_page(spark, d):
    en, ta = derived(spark, d, EN), derived(spark, d, TA)
    pairs = en.select("part_no", F.col("page_no").alias("page")).distinct().join(ta.select("part_no", F.col("page_no").alias("other_page")).distinct(), "part_no")
    scored = pairs.join(J.page_overlap(en, ta), ["part_no", "page", "other_page"], "left").withColumn("has_ids", F.lit(True))
    return J.best_page(scored, ["part_no", "page"])


def _side(key: str) -> str:
    return f"SELECT page, {key}, arg_max(name, cell_index) AS name, arg_max(relation, cell_index) AS relation FROM rt WHERE CAST({key} AS VARCHAR) <> '' GROUP BY page, {key}"


@query(
    "record_match",
    f"""WITH l AS ({LEFT_SIDE}), rt AS ({RIGHT_SIDE}),
        j AS (SELECT l.*, i.name AS i_name, i.relation AS i_rel, s.name AS s_name, s.relation AS s_rel, coalesce(p.name, '') AS p_name, coalesce(p.relation, '') AS p_rel FROM l
              LEFT JOIN ({_side('epic_id')}) i ON i.page = l.page AND i.epic_id = l.epic_id LEFT JOIN ({_side('serial_no')}) s ON s.page = l.page AND s.serial_no = l.serial_no
              LEFT JOIN ({_side('cell_index')}) p ON p.page = l.page AND p.cell_index = l.cell_index),
        a AS (SELECT *, i_name IS NOT NULL AND epic_confidence >= 70 AS use_id FROM j),
        b AS (SELECT *, CASE WHEN use_id THEN i_name ELSE '' END AS n1, CASE WHEN use_id THEN i_rel ELSE '' END AS r1, CASE WHEN use_id THEN 'id' ELSE '' END AS m1 FROM a),
        c AS (SELECT *, CASE WHEN n1 = '' AND s_name IS NOT NULL THEN s_name ELSE n1 END AS n2, CASE WHEN n1 = '' AND s_name IS NOT NULL THEN s_rel ELSE r1 END AS r2,
              CASE WHEN n1 = '' AND s_name IS NOT NULL THEN 'serial' ELSE m1 END AS m2 FROM b),
        e AS (SELECT *, n2 = '' AND p_name <> '' AS use_place, m2 = 'id' AND epic_confidence < 80 AND p_name <> '' AND p_name <> n2 AS doubt FROM c)
        SELECT page, cell_index, epic_id, epic_confidence, serial_no, CASE WHEN use_place OR doubt THEN p_name ELSE n2 END AS name,
        CASE WHEN use_place OR doubt THEN p_rel ELSE r2 END AS relation, CASE WHEN use_place THEN 'position' WHEN doubt THEN 'position_override' ELSE m2 END AS match_method FROM e""",
)
def record_match(spark, d):
    return J.match_records(derived(spark, d, LEFT_SIDE), derived(spark, d, RIGHT_SIDE), ["page"])


@query(
    "serial_backfill",
    f"""SELECT l.page, l.cell_index, l.epic_id, CASE WHEN l.serial_no = '' THEN coalesce(k.serial, '') ELSE l.serial_no END AS serial_no FROM ({LEFT_SIDE}) l
        LEFT JOIN (SELECT page, epic_id, arg_min(serial_no, cell_index) AS serial FROM ({RIGHT_SIDE}) WHERE epic_id <> '' AND serial_no <> '' GROUP BY page, epic_id) k
        ON k.page = l.page AND k.epic_id = l.epic_id""",
)
def serial_backfill(spark, d):
    return J.backfill_serials(derived(spark, d, LEFT_SIDE), derived(spark, d, RIGHT_SIDE), ["page"]).select("page", "cell_index", "epic_id", "serial_no")


#: the second reading lacks every ninth page; house numbers carry the guard or a stray sign
_CHECK = f"""SELECT l.page, l.cell_index, l.epic_id, l.serial_no, r.epic_id AS other_epic, r.serial_no AS other_serial, coalesce(r.name, '') AS other_name, r.page IS NOT NULL AS paired,
    CASE WHEN l.serial_no = '' THEN '' ELSE concat(chr(39), CAST(l.page % 90 AS VARCHAR(20)), '-B') END AS house,
    CASE WHEN r.serial_no = '' OR r.page IS NULL THEN '' ELSE concat('#', CAST((l.page + l.cell_index % 2) % 90 AS VARCHAR(20)), '-B') END AS other_house
  FROM ({LEFT_SIDE}) l LEFT JOIN (SELECT * FROM ({RIGHT_SIDE}) x WHERE page % 9 <> 0) r ON r.page = l.page AND r.cell_index = l.cell_index"""


@query(
    "cross_check",
    f"""SELECT page, cell_index, notes, CASE WHEN NOT paired THEN 'UNVERIFIED' WHEN notes <> '' THEN 'REVIEW' ELSE 'OK' END AS status FROM (
        SELECT *, concat_ws('; ', CASE WHEN epic_id <> '' AND other_epic <> '' AND epic_id <> other_epic THEN 'id: ' || epic_id || ' vs ' || other_epic END,
          CASE WHEN house <> '' AND other_house <> '' AND replace(house, chr(39), '') <> replace(other_house, '#', '') THEN 'house: ' || replace(house, chr(39), '') || ' vs ' || replace(other_house, '#', '') END,
          CASE WHEN serial_no <> '' AND other_serial <> '' AND serial_no <> other_serial THEN 'serial: ' || serial_no || ' vs ' || other_serial END,
          CASE WHEN other_name <> '' AND (20.0 / length(other_name) > 5 OR 20.0 / length(other_name) < 0.2) THEN 'name length' END) AS notes FROM ({_CHECK}))""",
)
def cross_check(spark, d):
    r = derived(spark, d, _CHECK)
    twenty = F.lit("x" * 20)
    a = {"epic": F.col("epic_id"), "house": F.col("house"), "serial": F.col("serial_no"), "name": twenty}
    b = {"epic": F.col("other_epic"), "house": F.col("other_house"), "serial": F.col("other_serial"), "name": F.col("other_name")}
    status, notes = J.cross_check(a, b, F.col("paired"))
    return r.select("page", "cell_index", notes.alias("notes"), status.alias("status"))


# ---------------------------------------------------------------- incremental


@query("pending_work", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_work(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    return I.pending(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), done, "key")


@query(
    "retry_failed",
    "SELECT event_id AS key FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ORDER BY event_id LIMIT 50",
)
def retry_failed(spark, d):
    done = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"))
    return I.selected(I.pending(table(spark, d, "events").select(F.col("event_id").alias("key")), done, "key", "status"), limit=50)


@query("dry_run", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY key LIMIT 10")
def dry_run(spark, d):
    return I.dry_run(pending_work(spark, d))[0]


# ---------------------------------------------------------------- geometry


@query(
    "grouped_positions",
    """SELECT l_suppkey AS page, CAST(floor(avg(p)) AS BIGINT) AS centre, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM (
       SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY l_suppkey ORDER BY p) <= 15 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT l_suppkey, l_partkey AS p FROM lineitem))) GROUP BY l_suppkey, g""",
)
def grouped_positions(spark, d):
    return G.grouped_positions(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("p")).distinct(), ["page"], "p")


@query(
    "proportional_cells",
    """WITH p AS (SELECT p_partkey AS page, 900 + p_partkey % 400 AS height, 600 + p_partkey % 300 AS width FROM part),
       a AS (SELECT *, CAST(floor(width * 0.02::DOUBLE) AS BIGINT) AS l, CAST(floor(height * 0.033::DOUBLE) AS BIGINT) AS t FROM p),
       b AS (SELECT *, (width - 2 * l) // 3 AS cw, (height - t - CAST(floor(height * 0.03::DOUBLE) AS BIGINT)) // 10 AS ch, unnest(range(30)) AS i FROM a)
       SELECT page, height, width, CAST(i AS INT) AS cell_index, l + (i % 3) * cw AS x1, t + (i // 3) * ch AS y1, l + (i % 3 + 1) * cw AS x2, t + (i // 3 + 1) * ch AS y2 FROM b""",
)
def proportional_cells(spark, d):
    k = F.col("p_partkey")
    return G.proportional_cells(table(spark, d, "part").select(k.alias("page"), (900 + k % 400).alias("height"), (600 + k % 300).alias("width")))


#: ruled pages: three columns and ten rows of lines three pixels wide, with ink in some of the cells
RULED = """SELECT s_suppkey AS page_key, CAST(640 + s_suppkey % 5 * 16 AS INT) AS height, CAST(480 + s_suppkey % 7 * 12 AS INT) AS width FROM supplier"""


def _drawn(batches):
    for batch in batches:
        for k, h, w in zip(batch["page_key"], batch["height"], batch["width"]):
            page = np.full((h, w), 255, np.uint8)
            for r in range(11):
                y = 15 + r * ((h - 30) // 10)
                page[y : y + 3, 8 : w - 8] = 0
            for c in range(4):
                x = 10 + c * ((w - 24) // 3)
                page[15 : 15 + 10 * ((h - 30) // 10), x : x + 3] = 0
            for i in range(30):
                if (k + i) % 3 == 0:
                    y, x = 25 + i // 3 * ((h - 30) // 10), 40 + i % 3 * ((w - 24) // 3)
                    page[y : y + 30, x : x + 30] = 0
            yield pd.DataFrame({"page_key": [k], "pixels": [page.tobytes()], "height": [h], "width": [w]})


@query(
    "page_grid",
    f"""WITH p AS (SELECT *, (height - 30) // 10 AS ch, (width - 24) // 3 AS cw, unnest(range(30)) AS i FROM ({RULED}))
        SELECT page_key, CAST(i AS INT) AS cell_index, CAST(11 + i % 3 * cw AS INT) AS x1, CAST(16 + i // 3 * ch AS INT) AS y1, CAST(11 + (i % 3 + 1) * cw AS INT) AS x2,
               CAST(16 + (i // 3 + 1) * ch AS INT) AS y2, (page_key + i) % 3 <> 0 AS empty FROM p""",
)
def page_grid(spark, d):
    return G.page_cells(derived(spark, d, RULED).mapInPandas(_drawn, "page_key long, pixels binary, height int, width int"))


# ---------------------------------------------------------------- files and run logs


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for files that a query writes and reads; it goes with the application."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return folder.toString()


_MAPPED = {"AC No": "part", "Part No": "part", "Serial No": "serial", "EPIC ID": "raw_id", "Name (English)": "name", "Name (Tamil)": "rel", "Relation Name (English)": "name", "Relation Name (Tamil)": "sex", "Relation Type": "rel", "House No": "house", "Age": "age", "Gender": "sex"}


@query(
    "page_files",
    "SELECT "
    + ", ".join(
        f"""CASE WHEN house <> '' AND NOT starts_with(house, chr(39)) THEN chr(39) || house ELSE house END AS "{c}" """ if c == "House No"
        else f'CAST({_MAPPED[c]} AS VARCHAR) AS "{c}"' if c in _MAPPED else f"""'' AS "{c}" """ for c in S.RECORD_COLUMNS
    )
    + f" FROM ({PEOPLE})",
)
def page_files(spark, d):
    path = scratch(spark, "pages")
    rows = K.record_rows(derived(spark, d, PEOPLE), _MAPPED)
    K.write_pages(rows.withColumn("part", F.col("Part No")), path, ["part"])
    return S.record_files(spark, path).select(*S.RECORD_COLUMNS)


@query(
    "run_log",
    """SELECT o_orderpriority AS directory, min(o_orderdate::TIMESTAMP) AS started, max(o_orderdate::TIMESTAMP) AS completed,
       CAST(epoch(max(o_orderdate::TIMESTAMP)) - epoch(min(o_orderdate::TIMESTAMP)) AS DOUBLE) AS duration_seconds, count(*) AS total_pairs, count_if(o_orderstatus = 'F') AS processed,
       CAST(sum(o_custkey) AS BIGINT) AS total_records, count_if(o_custkey % 10 = 0) AS warnings, count_if(o_orderstatus = 'P') AS errors FROM orders GROUP BY o_orderpriority""",
)
def run_log(spark, d):
    when, status = F.col("o_orderdate").cast("timestamp"), F.col("o_orderstatus")
    pages = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("directory"), when.alias("started"), when.alias("completed"), (status == "F").alias("processed"),
        F.col("o_custkey").alias("n_records"), (F.col("o_custkey") % 10 == 0).cast("int").alias("n_warnings"), (status == "P").cast("int").alias("n_errors"),
    )
    path = scratch(spark, "runs")
    K.append_manifest(K.run_summaries(pages), path)
    return spark.read.parquet(path)


@query("directories", "SELECT DISTINCT 'AC-' || CAST(c_custkey % 150 AS VARCHAR) AS directory FROM customer WHERE c_custkey % 4 <> 0 ORDER BY directory")
def directories(spark, d):
    k = F.col("c_custkey")
    path = F.concat(F.lit("/data/AC-"), (k % 150).cast("string"), F.when(k % 4 == 0, "/tamil/").otherwise("/english/"), k.cast("string"), F.lit(".pdf"))
    return S.directories(table(spark, d, "customer").select(path.alias("path")))


_LOGS = """SELECT concat('logs/run-', CAST(o_orderkey AS VARCHAR(20)), CASE o_orderkey % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.json' ELSE '.tmp' END) AS path,
  CAST(o_custkey * 37 AS BIGINT) AS length, o_orderdate AS day, o_orderkey AS k FROM orders"""


@query(
    "log_listing",
    f"""SELECT substr(path, 6) AS name, round_even(length / 1024.0::DOUBLE, 1) AS size_kb, day::TIMESTAMP AS "modificationTime" FROM ({_LOGS})
        WHERE path LIKE '%.log' OR path LIKE '%.json' ORDER BY day DESC, name LIMIT 100""",
)
def log_listing(spark, d):
    return S.log_listing(derived(spark, d, _LOGS).withColumn("modificationTime", F.col("day").cast("timestamp")))


# ---------------------------------------------------------------- summaries over several tables


@query(
    "directory_summary",
    """WITH m AS (SELECT c_mktsegment AS directory, o_orderstatus = 'F' OR c_mktsegment = 'BUILDING' AS done, o_custkey AS n FROM orders JOIN customer ON c_custkey = o_custkey),
       p AS (SELECT directory, count(*) AS total, count_if(done AND directory <> 'MACHINERY') AS done,
             CAST(sum(CASE WHEN done AND directory <> 'MACHINERY' THEN n ELSE 0 END) AS BIGINT) AS records FROM m GROUP BY directory),
       f AS (SELECT c_mktsegment AS directory, count_if(c_nationkey < 12) AS n_first, CASE WHEN c_mktsegment < 'C' THEN count_if(c_nationkey < 12) ELSE count_if(c_nationkey >= 12) END AS n_second FROM customer GROUP BY 1),
       r AS (SELECT c_mktsegment AS directory, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_run FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
       SELECT p.directory, total, done, records, total - done AS pending, round_even(done * 100.0::DOUBLE / total, 1) AS pct, n_first, n_second, n_first > 0 AND n_first = n_second AS valid,
       CASE WHEN total = done THEN 'complete' WHEN done > 0 THEN 'partial' ELSE 'new' END AS state, last_run FROM p JOIN f USING (directory) JOIN r USING (directory)""",
)
def directory_summary(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("directory"), "c_nationkey")
    o = table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    done = ((F.col("o_orderstatus") == "F") | (F.col("directory") == "BUILDING")) & (F.col("directory") != "MACHINERY")
    manifest = o.select("directory", done.alias("done"), F.col("o_custkey").alias("n_records"))
    low, high = F.count_if(F.col("c_nationkey") < 12), F.count_if(F.col("c_nationkey") >= 12)
    counts = c.groupBy("directory").agg(low.alias("n_first"), F.when(F.col("directory") < "C", low).otherwise(high).alias("n_second"))
    runs = o.select("directory", F.struct("o_orderdate", "o_orderkey").alias("completed"), "o_orderkey")
    out = M.directory_summary(manifest, counts, runs)
    return out.select("directory", "total", "done", "records", "pending", "pct", "n_first", "n_second", "valid", "state", F.col("last_run.o_orderkey").alias("last_run"))


@query(
    "legacy_rows",
    "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)",
)
def legacy_rows(spark, d):
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return S.with_legacy(new, table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), "k")


@query(
    "conversation_positions",
    "SELECT conv_id, count(*) AS n_records, max(turn) AS last_turn FROM conversations GROUP BY conv_id HAVING NOT count(*) BETWEEN 4 AND 6",
)
def conversation_positions(spark, d):
    c = table(spark, d, "conversations")
    odd = W.odd_pages(c, ["conv_id"], 4, 6)
    return odd.join(c.groupBy("conv_id").agg(F.max("turn").alias("last_turn")), "conv_id")
