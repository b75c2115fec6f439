"""A corpus pipeline of four stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm import mixing, near_dedup, packing, quality
from pulseloom.llm.common import new_path, saved, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null and empty texts are judged by its bias, repeated rows each."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row's own, _dedup_row: that of its file and its place there, so it is the same whenever the files are read."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = saved(docs, "documents")
    place = docs.select("*", F.col("_metadata.file_path").alias("_dedup_file"), F.col("_metadata.row_index").alias("_dedup_index"))
    files = place.select("_dedup_file").distinct()
    files = saved(files.withColumn("_dedup_number", F.row_number().over(Window.orderBy("_dedup_file"))), "files")
    # The list of files is no larger than what the driver holds to plan a scan of them.
    met = place.join(F.broadcast(files), "_dedup_file")
    return met.select(*docs.columns, (F.shiftleft(F.col("_dedup_number").cast("long"), 36) + F.col("_dedup_index")).alias("_dedup_row"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each near-duplicate class, that of the smallest doc_id; rows without a doc_id stay, as does a text without words.

    Rows that repeat a doc_id are texts of their own: those that are no near-duplicates all stay. Classes are found
    and their row is chosen by numbers of rows; the texts are filtered once, by a key that no two rows share.
    """
    rows = numbered(docs)
    known = rows.where(F.col("doc_id").isNotNull())
    classes = near_dedup.near_duplicates(known.select(F.col("_dedup_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_dedup_row"), "component_id")
    named = known.select("doc_id", "_dedup_row").join(classes, "_dedup_row")
    # Combined before the shuffle, so a class of any size costs a row a task.
    kept = saved(named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_dedup_row")).alias("r")).select("r._dedup_row"), "kept")
    # A merge join at every size: what stays grows with the documents and is never sent to all tasks.
    return rows.join(kept.hint("merge"), "_dedup_row", "left_semi").select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each once, in files that hold consecutive parts of the mixture; null sources are one source."""
    return mixing.in_mixture_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; null and empty texts are the end id alone.

    A task packs what it reads, a few files of the mixture, so a sequence's documents stood near each other in it;
    sequences are not numbered by it.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: The classifier's training and the tokenizer can't be written as SQL; tests compare the stages with plain versions.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
