"""What the training-data operators share: the shared folder, saved tables, small Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode (tests) a temporary one where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, whatever else the table carries; a null text is the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches in which `column` holds about max_bytes (one longer value stands alone)."""
    for batch in batches:
        sizes = [len(x) if x is not None else 0 for x in batch.column(column).to_pylist()] if batch.num_rows else []
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


#: Copies of a row that are made in one place.
COPIES = 4096


def copies(df: DataFrame, n: str, keys: list[str], name: str, most: int = COPIES) -> DataFrame:
    """Each row of df as often as its column n says (once at least), numbered from 0 in `name`.

    Rows with large counts are cut into parts of `most` copies, which are dealt anew by keys (names that tell rows
    apart) and part, so a row of any count neither is one task's work nor one array.
    """
    last = F.greatest(F.col(n), F.lit(1)) - 1
    parts = df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / most)))).repartition(*keys, "_part")
    first = F.col("_part") * most
    return parts.withColumn(name, F.explode(F.sequence(first, F.least(first + most - 1, last)))).drop("_part")


def join_skewed(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 256) -> DataFrame:
    """rows left-joined with groups (one row per key, with its number of rows in `size`).

    Keys that hold more than 1/share of all rows are fewer than `share`, so they are broadcast; the rest
    shuffles. Rows of the broadcast keys and rows without a key have no partner there and are dealt at random,
    so that no task gets a hot key.
    """
    values = [c for c in groups.columns if c != key]
    kind = dict(rows.dtypes)[key]
    hot = groups.where(F.col(size) * share > F.lit(total))
    hot = hot.select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = groups.where(F.col(size) * share <= F.lit(total)).select(F.col(key).alias("_cold_key"), F.lit(-1).alias("_place"), F.struct(*values).alias("_cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    free = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    none = F.lit(None).cast(kind)
    out = out.withColumn("_dealt", F.when(free, F.floor(F.rand(1) * 65536).cast("int")).otherwise(-1)).withColumn("_join", F.when(free, none).otherwise(F.col(key)))
    # Both columns are keys of the shuffle, so dealt rows spread over all tasks; no group has a place of theirs.
    out = out.join(cold, F.col("_join").eqNullSafe(F.col("_cold_key")) & (F.col("_dealt") == F.col("_place")), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in values])
