"""Exact inner-product top-k by block-at-a-time pruning.

Rows are put in order once, by the nearest of a few pivots, and cut into blocks of neighbouring rows: the block's
vectors (its forward index) with the largest and smallest term of every dimension, and a ball around them. A query
orders a shard's blocks by their bounds, the sum of its best terms or what the ball allows, scores whole blocks, and
stops where a bound is below its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, saved

#: Rows of a block and of a shard, query rows that one round sends to all tasks, and rows that set the order and the first bounds.
BLOCK, SHARD, QUERIES, PIVOTS = 64, 16384, 16384, 512
EVERY, K = 50, 5
#: Sums of products below this are exact in double precision.
_EXACT = 2.0**53


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (floor(256 x) of each component, as doubles) of the rows that take part."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    # floor() of a double makes a long and stops at its range; larger doubles are whole numbers already.
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 2.0**44, F.floor(x.cast("double") * 256).cast("double")).otherwise(x.cast("double") * 256))
    return embeddings.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _by_length(ids: list[int], vectors: list[list[float]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors of each length."""
    groups: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        groups.setdefault(len(v), []).append(k)
    return {n: (np.array([ids[k] for k in at], np.int64), np.array([vectors[k] for k in at], np.float64).reshape(len(at), n)) for n, at in groups.items()}


class Block:
    """Neighbouring rows with what bounds their scores."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.high, self.low = x.max(axis=0, initial=-np.inf), x.min(axis=0, initial=np.inf)
        self.centre = x.mean(axis=0)
        self.radius = float(np.sqrt(((x - self.centre) ** 2).sum(axis=1)).max())
        self.most = float(np.abs(x).max(initial=0))


def bounds_of(q: np.ndarray, blocks: list[Block]) -> np.ndarray:
    """For each query and block a number that no score in the block exceeds."""
    high, low = np.stack([b.high for b in blocks]), np.stack([b.low for b in blocks])
    centre, radius = np.stack([b.centre for b in blocks]), np.array([b.radius for b in blocks])
    terms = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    ball = q @ centre.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius
    # Room for what the ball's square roots and means round off.
    return np.minimum(terms, ball + 1e-6 * (1 + np.abs(ball)))


class Search:
    """The k best rows of each query so far. `floor` holds scores that k rows of other ids are known to reach."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.q, self.floor, self.k = ids, q, floor, k
        self.scores, self.rows = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.most = float(np.abs(q).max(initial=0))
        self.visited = self.possible = 0
        self.wide: dict[int, list[tuple[int, int]]] = {}

    def least(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, who: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
        """Merges candidates (query numbers, scores, row ids): by falling score, then rising id."""
        some = np.unique(who)
        who = np.concatenate((np.repeat(some, self.k), who))
        scores, rows = np.concatenate((self.scores[some].ravel(), scores)), np.concatenate((self.rows[some].ravel(), rows))
        order = np.lexsort((rows, -scores, who))
        first = np.searchsorted(who[order], some)
        best = order[first[:, None] + np.arange(self.k)]
        self.scores[some], self.rows[some] = scores[best], rows[best]

    def shard(self, blocks: list[Block]) -> None:
        """Searches blocks of vectors of the queries' length: each query its best block, then all their second, and so on."""
        self.possible += len(blocks) * len(self.ids)
        if max(b.most for b in blocks) * self.most * max(1, self.q.shape[1]) >= _EXACT:
            self._whole_numbers(blocks)
            return
        bounds = bounds_of(self.q, blocks)
        order = np.argsort(-bounds, axis=1, kind="stable")
        active = np.arange(len(self.ids))
        for turn in range(len(blocks)):
            mine = order[active, turn]
            go = bounds[active, mine] >= self.least()[active]
            active, mine = active[go], mine[go]
            if not len(active):
                break
            self.visited += len(active)
            found = []
            by_block = np.argsort(mine, kind="stable")
            for group in np.split(by_block, np.flatnonzero(np.diff(mine[by_block])) + 1):
                block, who = blocks[mine[group[0]]], active[group]
                scores = self.q[who] @ block.x.T
                near = (scores >= self.least()[who][:, None]) & (block.ids[None, :] != self.ids[who][:, None])
                i, j = np.nonzero(near)
                found.append((who[i], scores[i, j], block.ids[j]))
            self.add(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def _whole_numbers(self, blocks: list[Block]) -> None:
        """Scores beyond double precision: every row in Python's whole numbers."""
        self.visited += len(blocks) * len(self.ids)
        for n, own in enumerate(self.ids.tolist()):
            a = [int(c) for c in self.q[n]]
            kept = self.wide.setdefault(n, [])
            for b in blocks:
                kept += [(-sum(c * int(d) for c, d in zip(a, v, strict=True)), i) for i, v in zip(b.ids.tolist(), b.x, strict=True) if i != own]
                kept[:] = sorted(kept)[: self.k]

    def result(self) -> list[tuple[int, int, int]]:
        """(query id, row id, score) of what was kept."""
        out = []
        for n, own in enumerate(self.ids.tolist()):
            kept = [(-int(s), i) for s, i in zip(self.scores[n].tolist(), self.rows[n].tolist(), strict=True) if s > -np.inf]
            out += [(own, i, -s) for s, i in sorted(kept + self.wide.get(n, []))[: self.k]]
        return out


def blocks_table(rows: DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]], total: int, block: int, shard: int) -> DataFrame:
    """ids, x, width of blocks of neighbouring rows: one shuffle of rows(vec_id, v), by the nearest pivot."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            nearest, along = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            for n, (at, x) in _by_length(list(range(len(vectors))), vectors).items():
                if n in pivots:
                    p = pivots[n][1] / np.maximum(np.sqrt((pivots[n][1] ** 2).sum(axis=1)), 1e-300)[:, None]
                    near = x @ p.T
                    nearest[at], along[at] = near.argmax(axis=1), near.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([len(v) for v in vectors], pa.int32()), pa.array(nearest), pa.array(along)], ["vec_id", "v", "width", "nearest", "along"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = ([], []), None

        def out() -> pa.RecordBatch:
            x = np.array(held[1], np.float64).reshape(len(held[0]), at[0])
            made = pa.RecordBatch.from_arrays([pa.array([np.array(held[0], np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([at[0]], pa.int32())], ["ids", "x", "width"])
            held[0].clear()
            held[1].clear()
            return made

        for batch in batches:
            for vec_id, v, *key in zip(*[batch.column(c).to_pylist() for c in ("vec_id", "v", "width", "nearest")], strict=True):
                # A block holds vectors of one length around one pivot.
                if held[0] and (key != at or len(held[0]) >= block):
                    yield out()
                at = key
                held[0].append(vec_id)
                held[1].append(v)
        if held[0]:
            yield out()

    placed = rows.mapInArrow(place, "vec_id long, v array<double>, width int, nearest int, along double")
    # Rows that repeat all of these, as a hot vec_id does, are told apart by where they stood, so a range can end among them.
    placed = placed.withColumn("place", F.monotonically_increasing_id())
    order = ["width", "nearest", "along", "vec_id", "place"]
    ranged = placed.repartitionByRange(max(1, -(-total // shard)), *order).sortWithinPartitions(*order)
    return saved(ranged.select("vec_id", "v", "width", "nearest").mapInArrow(cut, "ids binary, x binary, width int"), "blocks")


def searched(embeddings: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """query_id, vec_id, score of the best rows that each task found for each query, and (with a null query_id) how
    many pairs of a query and a block each task scored and had, as vec_id and score.

    Rows are shuffled once. Queries, at most `queries` rows in a round, are broadcast, so a round reads the blocks
    where they are and sends k rows a query and task on.
    """
    spark = embeddings.sparkSession
    rows = scaled(embeddings)
    total = rows.count()
    # The rows of the smallest hashes, a bounded number: pivots of the order, and candidates whose k-th score is a first bound.
    some = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOTS).collect()
    pivots = _by_length([r["vec_id"] for r in some], [r["v"] for r in some])
    blocks = blocks_table(rows, pivots, total, block, shard)
    # More than k copies of a query row can't show.
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    asked = asked.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))).alias("copy"))
    order = F.pmod(F.xxhash64("vec_id", "v", "copy"), F.lit(1 << 30))
    asked = saved(asked.withColumn("place", order), "queries")
    lists = max(1, -(-asked.count() // queries))
    folder = new_path(spark, "best")
    schema = "query_id long, vec_id long, score long"
    for number in range(lists):
        low, high = (number << 30) // lists, (number + 1 << 30) // lists
        mine = asked.where((F.col("place") >= low) & (F.col("place") < high)).select("vec_id", "v").toArrow()
        groups = _by_length(mine["vec_id"].to_pylist(), mine["v"].to_pylist())
        sent = spark.sparkContext.broadcast({n: (ids, q, _floors(ids, q, pivots.get(n), k)) for n, (ids, q) in groups.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searches = {n: Search(ids, q, floor, k) for n, (ids, q, floor) in sent.value.items()}
            waiting: dict[int, list[Block]] = {}
            for batch in batches:
                for ids, x, width in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if width in searches:
                        here = waiting.setdefault(width, [])
                        ids = np.frombuffer(ids, np.int64)
                        here.append(Block(ids, np.frombuffer(x, np.float64).reshape(len(ids), width)))
                        if sum(len(b.ids) for b in here) >= shard:
                            searches[width].shard(here)
                            here.clear()
            for width, here in waiting.items():
                if here:
                    searches[width].shard(here)
            limit = 2**63
            found = [r for s in searches.values() for r in s.result()]
            found.append((None, sum(s.visited for s in searches.values()), sum(s.possible for s in searches.values())))
            columns = [[r[0] for r in found], [r[1] for r in found], [max(-limit, min(limit - 1, r[2])) for r in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        blocks.mapInArrow(run, schema).write.mode("append").parquet(folder)
        sent.unpersist()
    return spark.read.schema(schema).parquet(folder)


def _floors(ids: np.ndarray, q: np.ndarray, pivots: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """For each query the k-th best score among the pivots of other ids, where it is exact; else nothing."""
    none = np.full(len(ids), -np.inf)
    if pivots is None or len(pivots[0]) < k or np.abs(q).max(initial=0) * np.abs(pivots[1]).max(initial=0) * max(1, q.shape[1]) >= _EXACT:
        return none
    scores = np.where(ids[:, None] == pivots[0][None, :], -np.inf, q @ pivots[1].T)
    return np.sort(scores, axis=1)[:, -k]


def exact_top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id `every` divides, the k rows of highest inner product.

    Every row but those of the query's own vec_id is a candidate; ties go to the smaller vec_id. A query's best of
    all tasks are merged by a window over k rows a task.

    Rows with a null vec_id, a null vector, or null, NaN or infinite components take no part. Vectors are compared
    with those of their own length only. As in the SQL, of rows that repeat a vec_id each is a candidate and each
    is a query: the k best pairs of all rows of a query's vec_id are ranked, and a repeated row takes a rank for
    each copy. Scores beyond 64 bits are cut to the nearest long. An empty table gives an empty result; other columns
    are ignored.
    """
    best = searched(embeddings, k, every, block, shard, queries).where("query_id is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visited_share(embeddings: DataFrame, **sizes: int) -> DataFrame:
    """visited, possible, share: how many pairs of a query and a block were scored, of all there are."""
    counts = searched(embeddings, **sizes).where("query_id is null").agg(F.sum("vec_id").alias("visited"), F.sum("score").alias("possible"))
    return counts.select("visited", "possible", (F.col("visited") / F.col("possible")).alias("share"))
