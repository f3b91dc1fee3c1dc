"""Corpus pipeline: five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  run() writes every stage as Parquet into the shared folder that spark.checkpoint.dir names
and reads it back as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formspark.llm.common import checkpointed, shared_folder, small_batches, table
from formspark.llm.decontaminate import contaminated
from formspark.llm.graph import components
from formspark.llm.mixing import fit_rates, memberships
from formspark.llm.simhash import fingerprint, links
from formspark.llm.suffix_dedup import suffix_dedup
from formspark.llm.toxicity import fit, score_texts

#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: bytes of input for each file that a stage writes
FILE_BYTES = 32 << 20


def packed(out: DataFrame, docs: DataFrame) -> DataFrame:
    """What a stage makes of docs in files of some FILE_BYTES, one for each core at least, not one for each small task."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return out.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, min(-(-size // FILE_BYTES), 1_000_000)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return packed(score_texts(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS), docs)


def row_key() -> Column:
    """Key of a row: its id and text, nulls included; only true repeats share one."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.sha2("text", 256), F.lit("")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id, once if it is repeated.

    Null ids come last; of rows with that id that differ in text one stays.  Documents without words
    all have the fingerprint zero and are one component.
    """
    keyed = docs.withColumn("_key", row_key())
    prints = small_batches(keyed).select("doc_id", "_key", fingerprint(F.col("text")).alias("fp"))
    row = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_key").alias("k"))
    # the fingerprint is the node, so that rows need no id to be linked
    least = checkpointed(prints.groupBy("fp").agg(F.min(row).alias("row")))
    found = components(links(least.select("fp", F.col("fp").alias("node"))))
    named = least.join(found, least["fp"] == found["node"], "left").select(F.coalesce("component", "fp").alias("component"), "row")
    kept = named.groupBy("component").agg(F.min("row").alias("row")).select(F.col("row.k").alias("_key"))
    return packed(keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents of which nothing is left go."""
    # the text travels once, as what is kept of it
    named = docs.withColumn("_no_text", F.col("text").isNull())
    cut = suffix_dedup(named, keep=["doc_id", "lang", "source", "n_chars", "_no_text"])
    out = cut.withColumn("text", F.when(~F.col("_no_text"), F.col("kept_text")))
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return packed(out.where((F.col("n_removed") == 0) | (F.trim(F.col("text")) != "")).select(*COLUMNS), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keyed = docs.withColumn("_key", row_key())
    leaks = contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_key").select("_key").distinct()
    return packed(keyed.join(leaks, "_key", "left_anti").select(*COLUMNS), docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with tokens, domain memberships and the rate at which to take them.

    The rates are fitted on tokens and memberships alone; a rate follows from its row's memberships, so
    the texts go nowhere.
    """
    members = memberships(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    rates = fit_rates(checkpointed(packed(members.select("tokens", "p_low", "p_toxic", "p_good"), docs)))
    return packed(members.select("*", rates.column().alias("rate")), docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("domain_mixing", mix_domains),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again.

    A stage's folder goes once the next one is written, the last with the application.
    """
    docs = table(spark, sf_dir, "documents")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    files, before = folder.getFileSystem(spark._jsc.hadoopConfiguration()), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder.toString()}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(before), True)
        before = path
    files.deleteOnExit(folder)
    return docs
