"""URL filters: host-suffix and path-prefix expressions joined to rules on short digest prefixes.

Every URL is expanded into all pairs of a host suffix (whole labels) and a path prefix that a rule
could have.  A pair's SHA-256 digest is cut to a short prefix for the equi-join; the full digests are
compared afterwards, and the longest rule that is left decides.

Only suffixes of at most as many labels as the deepest rule, and only path prefixes of a length that
some rule has, can match, so the expansion is bounded by the rules and loses nothing for any URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

#: verdict, host and path of the production rules
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Rules up to this number are broadcast; beyond it the join is shuffled, with salted URLs.
BROADCAST_RULES = 100_000
SALTS = 32
#: hexadecimal digits of the short digest: 32 bits
SHORT = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + F.lit(3), F.length(url))
    return F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + F.lit(3), F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    rows = [(v, h, p) for v, h, p in (RULES if rules is None else rules)]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def url_filter(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per input row: the id, host, path, rule and verdict.

    rules: verdict, host, path.  A rule fits its host and all subdomains where the URL's path starts
    with the rule's path.  The longest host + path wins; between equal rules ``block`` wins.  Rules
    with a null host or path are ignored, repeated ones count once.  No rule fits: rule is null and
    the verdict is ``default``.  Null URLs and those without ``://`` have an empty host and path.
    Repeated input rows stay repeated; other columns of pages are not read.
    """
    kept = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .select("verdict", ascii_lower(F.col("host")).alias("host"), "path")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    # a handful of numbers about the rules, never the rules themselves
    shape = kept.agg(
        F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")
    ).first()
    host, path = fresh("host"), fresh("path")
    # a row is named by its values, which every evaluation of the input gives alike; equal rows are one with a number
    urls = (
        pages.select(F.col(id_col), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias(host), F.coalesce(path_of(F.col(url_col)), F.lit("")).alias(path))
        .groupBy(id_col, host, path)
        .agg(F.count("*").cast("int").alias("_copies"))
    )
    labels, lengths = shape["labels"] or 1, shape["lengths"] or [0]
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)),
        lambda n: F.substring(F.col(path), F.lit(1), n),
    )
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, p), 256))))
    wide = urls.withColumn("_digest", F.explode_outer(expressions)).withColumn("_short", F.substring("_digest", 1, SHORT))
    keyed = kept.select(
        F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict"), F.sha2(F.concat("host", "path"), 256).alias("_full")
    ).withColumn("_key", F.substring("_full", 1, SHORT))
    # rules whose short digests agree, which few do, come in one row
    keyed = keyed.groupBy("_key").agg(F.collect_list(F.struct("_full", "_rule", "_verdict")).alias("_rules"))
    if shape["n"] <= BROADCAST_RULES:
        joined = wide.join(F.broadcast(keyed), F.col("_short") == F.col("_key"), "left")
    else:
        salted = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        wide = wide.withColumn("_s", F.pmod(F.xxhash64(id_col, host, path), F.lit(SALTS)).cast("int"))
        joined = wide.join(salted, (F.col("_short") == F.col("_key")) & (F.col("_s") == F.col("_salt")), "left")
    fits = F.filter(F.coalesce("_rules", F.array()), lambda r: r["_full"] == F.col("_digest"))
    best = F.max(F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["_rule"]).alias("n"), r["_verdict"].alias("verdict"), r["_rule"].alias("rule")))))
    return (
        joined.groupBy(id_col, host, path)
        .agg(best.alias("_best"), F.first("_copies").alias("_copies"))
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
        .select(
            F.col(id_col),
            F.col(host).alias("host"),
            F.col(path).alias("path"),
            F.col("_best.rule").alias("rule"),
            F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
        )
    )
