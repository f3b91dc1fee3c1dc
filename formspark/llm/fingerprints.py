"""Document fingerprints by one-permutation MinHash, in DataFrame expressions only.

Every shingle of five words is hashed once.  The top 8 bits of a hash choose one of 256 bins and the
smallest hash of a bin is its value.  An empty bin takes the value of the first full bin on its own
pseudo-random sequence of bins (optimal densification), which depends on the bin and the attempt
only, so that it is the same for every document.  The low 4 bits of each bin's
value, hashed with the bin, are packed into 16 integers.  The share of equal nibbles of two fingerprints, less the 1/16 that agree by chance, is the
estimate of the resemblance of their sets of shingles.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, partitions

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 4
_REST = (1 << (64 - BIN_BITS)) - 1
_PER_WORD = 64 // LOW_BITS
_WORDS = BINS // _PER_WORD
#: rows of a range, as long as there are no more ranges than this or than shuffle partitions
ROWS = 20_000
MOST_RANGES = 4_096
#: cuts that a row is compared with at once
FAN = 64
#: attempts of densification are made in growing rounds, as an expression cannot stop in the middle of one
_ROUNDS = ((1, 4), (5, 16), (17, 64))


def _shingles(words: Column) -> Column:
    """Hashes of all shingles of an array of word hashes; of the whole array where it is shorter."""
    whole = F.array(F.xxhash64(words))
    each = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) == 0, F.expr("cast(array() as array<bigint>)")).when(F.size(words) < SHINGLE, whole).otherwise(each)


def _bins(hashes: Column) -> Column:
    """The smallest hash of each bin in order; a bin's largest possible hash stands for an empty bin."""
    last = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft((b - BINS // 2).cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(_REST)))
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    return let(
        F.sort_array(F.concat(hashes, last)),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(F.get(s, i - 1)) != bin_of(x))),
    )


def _empty(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_REST)) == F.lit(_REST)


def _densified(bins: Column) -> Column:
    """Low bits of every bin, empty ones from the first full bin on their sequence; all zero if all are empty."""

    def borrowed(b: Column) -> Column:
        at = lambda t: F.get(bins, F.xxhash64(t, b).bitwiseAND(F.lit(BINS - 1)).cast("int"))
        tries = [F.get(F.filter(F.transform(F.sequence(F.lit(a), F.lit(z)), at), lambda v: ~_empty(v)), F.lit(0)) for a, z in _ROUNDS]
        around = F.transform(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda t: F.get(bins, F.pmod(b + t, F.lit(BINS))))
        return F.coalesce(*tries, F.get(F.filter(around, lambda v: ~_empty(v)), F.lit(0)), F.lit(0).cast("long"))

    # hashed with the bin, so that the bins of a text of few shingles do not all agree by one chance
    mixed = lambda x, b: F.xxhash64(F.when(_empty(x), borrowed(b)).otherwise(x), b)
    full = F.transform(bins, lambda x, b: mixed(x, b).bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long")))
    none = F.transform(bins, lambda x: F.lit(0).cast("long"))
    return F.when(F.exists(bins, lambda x: ~_empty(x)), full).otherwise(none)


def _packed(low: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(_WORDS - 1)),
        lambda w: F.aggregate(F.slice(low, w * _PER_WORD + 1, _PER_WORD), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x)),
    )


def fingerprint(text: Column) -> Column:
    """Packed fingerprint (16 integers) of a text that is not null; all zero for a text without words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(let(let(hashed, _shingles), _bins), _densified), _packed)


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance from 0 to 1 of two packed fingerprints, corrected for chance agreement."""
    ones = F.lit(0x1111111111111111)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(ones))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), ((1.0 - unequal / BINS) - chance) / (1.0 - chance))


def as_text(packed: Column) -> Column:
    """256 hexadecimal digits, one for each bin."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_chars and ``fingerprint``; null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.length(text).cast("long").alias("n_chars"), as_text(fingerprint(text)).alias("fingerprint"))


def _constants(values: list[int]) -> Column:
    """A constant array of integers; one string of the plan in place of a literal each."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.expr("cast(array() as array<bigint>)")


def _below(cuts: list[int], key: Column) -> Column:
    """How many of the sorted cuts are below the key, in a few blocks of FAN comparisons."""
    if len(cuts) <= FAN:
        return F.size(F.filter(_constants(cuts), lambda c: c < key))
    block = F.greatest(_below(cuts[::FAN], key) - 1, F.lit(0))
    return let(block, lambda b: b * FAN + F.size(F.filter(F.slice(_constants(cuts), b * FAN + 1, FAN), lambda c: c < key)))


def _cuts(keys: DataFrame, n: int) -> list[int]:
    """n - 1 quantiles at most; the driver gets one number for each range."""
    got = keys.agg(F.percentile_approx("k", [k / n for k in range(1, n)], 20 * n).alias("cuts")).first()["cuts"] if n > 1 else None
    return sorted(set(got or []))


def _labels(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n partitions that hash partitioning puts there, so that no task gets two ranges."""
    tried = spark.range(30 * n + 100).select(F.col("id").alias("x"), F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    found = {r["p"]: r["x"] for r in tried.groupBy("p").agg(F.min("x").alias("x")).collect()}
    spare = itertools.count(30 * n + 100)
    return [found[k] if k in found else next(spare) for k in range(n)]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike these and the next text's are.

    Ids are integers.  The next document is that of the next smaller id, after the last the first;
    repeated ids follow each other by text, and null ids come last, by a hash of their texts and these.
    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the
    next document.  Null texts are empty; a single document is its own next one.  Other columns of
    docs are not read.

    Documents are dealt into ranges of ids (of hashes where the id is null) of some ROWS rows, each a
    partition of its own, and the first of each range goes to the range above it as well, so each looks
    up the next within its range and no range is larger than another by much.
    """
    spark, text, n_parts = docs.sparkSession, F.coalesce(F.col(text_col), F.lit("")), partitions(docs.sparkSession)
    no_id, named = F.col(id_col).isNull(), F.col(id_col).cast("long")
    size = docs.agg(F.count("*").alias("n"), F.count_if(no_id).alias("nulls")).first()
    ranges = max(n_parts, min(size["n"] // ROWS, MOST_RANGES), 2)
    share = size["nulls"] / max(size["n"], 1)
    # ids take the ranges from 0 up, rows without one those below 0
    cuts = _cuts(docs.where(~no_id).select(named.alias("k")), max(1, round(ranges * (1 - share))))
    key, own = named, _below(cuts, named)
    if size["nulls"]:
        hashed = F.xxhash64(text)
        more = _cuts(docs.where(no_id).select(hashed.alias("k")), max(1, round(ranges * share)))
        key, own = F.when(no_id, hashed).otherwise(named), F.when(no_id, _below(more, hashed) - len(more) - 1).otherwise(own)
    heads = sorted((r["b"], r["k"]) for r in docs.select(own.alias("b"), key.alias("k")).groupBy("b").agg(F.max("k").alias("k")).collect())
    # by its number from the lowest: a range's first key, and the label of its partition
    lowest = heads[0][0] if heads else 0
    place, firsts = {b: i for i, (b, _) in enumerate(heads)}, dict(heads)
    numbers = range(lowest, heads[-1][0] + 1) if heads else []
    labels = _labels(spark, max(len(heads), 1))
    at = lambda values: F.get(_constants(values), F.col("_own") - lowest)
    label = at([labels[place[b]] if b in place else 0 for b in numbers])
    above = at([labels[(place[b] + 1) % len(heads)] if b in place else 0 for b in numbers])
    first = at([firsts.get(b, 0) for b in numbers])
    base = docs.select(key.alias("_key"), F.col(id_col).alias("_id"), text.alias("_text"), fingerprint(text).alias("_print"), own.alias("_own"))
    copies = F.array(F.struct(label.alias("at"), F.lit(0).alias("ghost")))
    # the first of a range goes to the next range above as well, that of the highest to the lowest
    dealt = base.withColumn("_at", F.explode(F.when(F.col("_key") == first, F.concat(copies, F.array(F.struct(above.alias("at"), F.lit(1).alias("ghost"))))).otherwise(copies)))
    dealt = dealt.select("_key", "_id", "_text", "_print", "_at.at", "_at.ghost").repartition(max(len(heads), 1), "at")
    order = Window.partitionBy("at").orderBy("ghost", F.col("_key").desc(), F.col("_text"))
    paired = dealt.select("*", F.lead("_text").over(order).alias("_next"), F.lead("_print").over(order).alias("_next_print")).where("ghost = 0")
    chars = F.length("_text")
    cut = F.floor(chars / 3).cast("int")
    edited = paired.select(
        "_id", chars.cast("long").alias("n_chars"), "_print", "_next_print",
        F.concat(F.substring("_text", F.lit(1), chars - cut), F.substring("_next", F.lit(1), cut)).alias("_edited"),
    )
    printed = edited.select("*", fingerprint(F.col("_edited")).alias("_edited_print"))
    return printed.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_print")).alias("fingerprint"), as_text(F.col("_edited_print")).alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"), likeness(F.col("_print"), F.col("_next_print")).alias("near_next"),
    )
