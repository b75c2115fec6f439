"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Documents of one block, and about how many slots one period of the schedule has.
BLOCK_ROWS, SLOTS = 1, 1000
#: Ids that one window task should sort at most when a source is one big group.
_IDS_PER_BUCKET = 2_000


def pfair_period(weights: dict) -> list[tuple]:
    """(source, k, release, deadline, slot) of every block in one period of sum(weights) slots.

    Block k of a source of weight w / W is released at floor((k - 1) W / w) and due at ceil(k W / w). In each
    slot the released block with the earliest deadline runs (ties: the heavier source, then the order given).
    As the weights fill the period, all deadlines are met and no source is ever a whole block off its share.
    """
    period = sum(weights.values())
    start: list[list[tuple]] = [[] for _ in range(period)]
    for order, (source, w) in enumerate(weights.items()):
        for k in range(1, w + 1):
            release, deadline = (k - 1) * period // w, -(-k * period // w)
            start[release].append((deadline, -w, order, k, source, release))
    ready: list[tuple] = []
    out = []
    for slot in range(period):
        for block in start[slot]:
            heapq.heappush(ready, block)
        deadline, _, _, k, source, release = heapq.heappop(ready)
        out.append((source, k, release, deadline, slot))
    return out


def tempered_weights(counts: dict, slots: int = SLOTS) -> dict:
    """The production target: each source by the square root of its rows, as whole slots of about `slots`, at least one."""
    roots = {s: n**0.5 for s, n in counts.items()}
    total = sum(roots.values())
    return {s: max(1, int(slots * roots[s] / total + 0.5)) for s in sorted(counts, key=lambda s: (s is not None, s))}


def mixture_order(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, repeat: bool = True) -> DataFrame:
    """doc_id, source, epoch, block, release, deadline, slot, place of every row of docs: ordered by (slot, place) they are the mixture.

    weights maps each source to a positive whole number (sources not named weigh one); by default they are
    tempered_weights. A source's rows stand in the order of md5(doc_id), and `block_rows` of them are a block.
    The schedule repeats after one period, so each row finds its slot from its own number: only that period, as
    many rows as slots, is made on the driver, and one row for each source is counted there.

    Sources run out at different times. With `repeat` a source that has begins anew (epoch 1, 2, ...), so that the
    target weights hold, less than one block off, until the source that lasts longest has run through once; its last
    period is filled up by all. No row is left out, and only rows of sources that end earlier come again. Without
    `repeat` every row comes once: slots of a source that has run out stay empty, the others keep their proportions,
    and the mixture as a whole has the natural shares (see realised_weights).

    A null source is a source of its own; null doc_ids come first in their source. Rows that repeat a doc_id are
    next to each other and counted, not sorted, so any number of them is one row of work. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source")
    counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    chosen = tempered_weights(counts) if weights is None else {s: weights.get(s, 1) for s in sorted(counts, key=lambda s: (s is not None, s))}
    period = sum(chosen.values())
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    turns = max((-(-blocks[s] // w) for s, w in chosen.items()), default=0)
    schema = T.StructType([T.StructField("_source", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("_k", "_release", "_deadline", "_slot", "_weight", "_blocks")]])
    plan = spark.createDataFrame([(s, k - 1, r, d, t, chosen[s], blocks[s]) for s, k, r, d, t in pfair_period(chosen)], schema)
    digits, most = 0, max(counts.values(), default=0)
    while most > _IDS_PER_BUCKET * 16**digits:
        digits += 1
    key = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    ids = rows.groupBy("source", "doc_id").agg(F.count("*").alias("_n")).withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    # Two levels of running counts: a source is never one task.
    sizes = ids.groupBy("source", "_bucket").agg(F.sum("_n").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), before.alias("_before"))
    in_bucket = F.coalesce(F.sum("_n").over(Window.partitionBy("source", "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = ids.withColumn("_in", in_bucket).join(sizes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    ids = ids.select("doc_id", "source", F.explode(F.sequence(F.col("_before") + F.col("_in"), F.col("_before") + F.col("_in") + F.col("_n") - 1)).alias("_row"))
    ids = ids.withColumn("_own", F.expr(f"_row div {block_rows}"))
    sources = plan.select(F.col("_source").alias("_of"), F.col("_weight").alias("_w"), F.col("_blocks").alias("_all")).distinct()
    ids = ids.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_of")))
    again = F.expr(f"(_w * {turns} - _own - 1) div _all") if repeat else F.lit(0).cast("long")
    ids = ids.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), again))).withColumn("block", F.col("_own") + F.col("epoch") * F.col("_all"))
    ids = ids.withColumn("_in_period", F.col("block") % F.col("_w")).withColumn("_turn", F.expr("block div _w"))
    ids = ids.join(F.broadcast(plan.select("_source", "_k", "_release", "_deadline", "_slot")), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_in_period") == F.col("_k")))
    shift = F.col("_turn") * period
    return ids.select("doc_id", "source", "epoch", "block", (F.col("_release") + shift).alias("release"), (F.col("_deadline") + shift).alias("deadline"), (F.col("_slot") + shift).alias("slot"), (F.col("_row") % block_rows).alias("place"))


def realised_weights(order: DataFrame) -> DataFrame:
    """source, rows, share, epochs of a mixture_order: the share of each source in the mixture as a whole, and how often it was begun."""
    total = order.agg(F.count("*").alias("_total"))
    each = order.groupBy("source").agg(F.count("*").alias("rows"), (F.max("epoch") + 1).alias("epochs"))
    return each.crossJoin(F.broadcast(total)).select("source", "rows", (F.col("rows") / F.col("_total")).alias("share"), "epochs")


def in_mixture_order(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows and columns of docs, each once, in files that hold consecutive parts of the mixture.

    The order is made of ids alone (mixture_order without `repeat`) and then joined to the rows, which are range
    partitioned and sorted by it. Rows that repeat a doc_id within a source stand together, at its first place, and
    rows without a doc_id at places dealt at random: order is all that the result keeps. Null sources are a source
    of their own; clashing columns pass through; an empty table stays empty.
    """
    order = mixture_order(docs, weights, block_rows, False)
    places = order.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(F.min(F.struct("slot", "place")).alias("_at"))
    last = order.agg(F.max("slot").alias("_last"))
    named = docs.where("doc_id is not null").join(places, (F.col("doc_id").cast("long") == F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")))
    rest = docs.where("doc_id is null").crossJoin(F.broadcast(last)).withColumn("_at", F.struct((F.rand(3) * F.col("_last")).cast("long").alias("slot"), F.lit(0).cast("long").alias("place")))
    both = named.select(*docs.columns, "_at").unionByName(rest.select(*docs.columns, "_at"))
    return both.repartitionByRange("_at").sortWithinPartitions("_at").select(*docs.columns)
