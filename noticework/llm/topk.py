"""Exact top-k by inner product, by reading sorted lists with no random access.

Candidates lie in blocks of like length, longest vectors first.  A block has one list per coordinate, sorted by value; a query reads
each list from the end that favours it, a slice a round.  What is read and the values where reading stopped bound each candidate's
score from below and above.  The first block gives every query a floor, its k-th best score there, which all other blocks share and
each task raises as it goes on: blocks whose longest vector cannot reach the first floor are not met, others are left as soon as few
candidates can still reach the floor; those are then resolved exactly.  The blocks' best rows are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from noticework.operators.ordering import best_rows
from noticework.session import settled

BLOCK_ROWS = 2048
QUERY_ROWS = 512
# Shares of the lists read after each round.
DEPTHS = tuple(i / 8 for i in range(1, 9))
# A query leaves a block with at most this many times k candidates left to resolve.
RESOLVE = 16
# Whole numbers below this add up exactly in half the width.
EXACT = 1 << 24
# Relative allowance for the rounding of vector lengths.
_SLACK = 1e-9

_BLOCK = StructType([StructField("part", IntegerType()), StructField("number", IntegerType()), StructField("block", LongType()), StructField("n", IntegerType()), StructField("longest", DoubleType()),
                     StructField("ids", BinaryType()), StructField("vectors", BinaryType()), StructField("width", IntegerType())])
_ASKED = StructType([StructField("asked", LongType()), StructField("query_ids", BinaryType()), StructField("queries", BinaryType()), StructField("query_width", IntegerType()),
                     StructField("floors", BinaryType()), StructField("reach", DoubleType())])

# What the search reads of blocks that met.
_SEARCHED = ("block", "ids", "vectors", "width", "asked", "query_ids", "queries", "query_width", "floors")


class SortedLists:
    """A block's vectors as lists that are read from their first entry on, two per coordinate: for positive weights the values in falling
    order, for negative weights the negated values in falling order.  ``entries`` has a row per list and a column per candidate, ``ranks``
    the place of every entry in its list."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.largest = ids, vectors, np.abs(vectors).max(initial=0)
        values = vectors.T.astype(np.float32 if self.largest < EXACT else np.float64)
        order = np.argsort(-values, axis=1, kind="stable")
        ranks = np.empty_like(order)
        np.put_along_axis(ranks, order, np.arange(len(ids))[None, :], axis=1)
        falling = np.take_along_axis(values, order, axis=1)
        self.entries, self.ranks = np.vstack([values, -values]), np.vstack([ranks, len(ids) - 1 - ranks])
        self.sorted = np.vstack([falling, -falling[:, ::-1]])

    def weights(self, queries: np.ndarray) -> np.ndarray:
        """What the lists weigh in each query (a row per query), in half the width if whole numbers add up exactly there."""
        both = np.hstack([np.maximum(queries, 0), np.maximum(-queries, 0)])
        return both.astype(np.float32 if self.largest * both.sum(axis=1).max(initial=0) < EXACT else np.float64)

    def most(self, weights: np.ndarray) -> np.ndarray:
        """The highest score that any candidate of the block could have, from the heads of the lists."""
        return weights @ self.sorted[:, 0]

    def read_to(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``depth`` entries of each list, and in place of all others the list's end, or the value where reading stopped."""
        read = self.ranks < depth
        # No unread entry lies above that value.  Products of a mask take a third of the time of np.where.
        return self.entries * read + self.sorted[:, -1:] * ~read, np.maximum(self.entries, self.sorted[:, depth - 1:depth])

    def between(self, weights: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores (a row per query) after ``depth`` entries of each list."""
        lowest, highest = self.read_to(depth)
        return weights @ lowest, weights @ highest

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for the positive weights ``up`` and the negative ones ``down``."""
        return self.between(self.weights(up + down), depth)


def block_top_k(lists: SortedLists, query_ids: np.ndarray, queries: np.ndarray, k: int,
                floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's best k candidates of a block, its own id left out, and the entries each query read.

    Candidates that score below a query's floor may be missing.
    """
    n = len(lists.ids)
    rank = min(k, n)
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    weights = lists.weights(queries)
    waiting = np.flatnonzero(lists.most(weights) >= floors)
    weights, floors, own = weights[waiting], floors[waiting].astype(weights.dtype), query_ids[waiting, None] == lists.ids
    used, read = (queries != 0).sum(axis=1), np.zeros(len(queries), np.int64)
    rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for share in DEPTHS:
        if not len(waiting):
            break
        depth = max(1, int(np.ceil(n * share)))
        read[waiting] = depth * used[waiting]
        lower, upper = lists.between(weights, depth)
        lower[own] = upper[own] = -np.inf
        # The k-th best lower bound raises the floor where so many lie above it.
        raised = np.count_nonzero(lower > floors[:, None], axis=1) >= rank
        floors[raised] = np.partition(lower[raised], n - rank, axis=1)[:, n - rank]
        open_to = (upper >= floors[:, None]) & ~own
        done = (np.count_nonzero(open_to, axis=1) <= RESOLVE * k) | (depth >= n)
        at, candidate = np.nonzero(open_to[done])
        rows.append(waiting[done][at])
        found.append(candidate)
        waiting, weights, floors, own = waiting[~done], weights[~done], floors[~done], own[~done]
    row, candidate = np.concatenate(rows), np.concatenate(found)
    scores = np.einsum("ij,ij->i", queries.astype(np.int64)[row], lists.vectors.astype(np.int64)[candidate]) if len(row) else np.empty(0, np.int64)
    order = np.lexsort((lists.ids[candidate], -scores, row))
    row, candidate, scores = row[order], candidate[order], scores[order]
    starts = np.searchsorted(row, row)
    best = np.arange(len(row)) - starts < k
    return row[best], candidate[best], scores[best], read


def _block(rows: pa.Table, part: int, number: int) -> pa.RecordBatch:
    ids = rows.column("id").to_numpy()
    lists = rows.column("vector").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    lengths = np.diff(lists.offsets.to_numpy())
    matrix = np.zeros((len(ids), max(int(lengths.max(initial=0)), 1)))
    matrix[np.repeat(np.arange(len(ids)), lengths), np.concatenate([np.arange(x) for x in lengths])] = lists.flatten().to_numpy(zero_copy_only=False)
    longest = float(np.sqrt((matrix * matrix).sum(axis=1).max(initial=0)))
    return pa.RecordBatch.from_pylist([{"part": part, "number": number, "block": (part << 32) + number, "n": len(ids), "longest": longest, "ids": ids.tobytes(), "vectors": matrix.tobytes(),
                                        "width": matrix.shape[1]}], schema=_ARROW_BLOCK)


_ARROW_BLOCK = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32())])


def _placed(vectors: DataFrame) -> DataFrame:
    """Equal rows are told apart by their place in the scan, so none of them fill a partition of their own."""
    return vectors.withColumn("place", F.xxhash64("id", F.monotonically_increasing_id()))


def _falling(vectors: DataFrame) -> DataFrame:
    """Rows (id, vector) in parts of falling vector length, each in that order."""
    keyed = _placed(vectors).withColumn("falling", -F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    return keyed.repartitionByRange("falling", "id", "place").sortWithinPartitions("falling", "id", "place")


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows (id, vector) as blocks of ``rows`` rows, cut by the task that holds them, in their order there."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            fresh_rows = pa.Table.from_batches([batch])
            held = fresh_rows if held is None else pa.concat_tables([held, fresh_rows])
            while held.num_rows >= rows:
                yield _block(held.slice(0, rows), part, number)
                held, number = held.slice(rows), number + 1
        if held is not None and held.num_rows:
            yield _block(held, part, number)

    return vectors.select("id", "vector").mapInArrow(cut, _BLOCK)


def _matrix(data: bytes, rows: int, width: int) -> np.ndarray:
    held = np.frombuffer(data).reshape(rows, -1)
    return np.pad(held, ((0, 0), (0, width - held.shape[1])))


_ARROW_ASKED = pa.schema([("asked", pa.int64()), ("query_ids", pa.binary()), ("queries", pa.binary()), ("query_width", pa.int32()), ("floors", pa.binary()), ("reach", pa.float64())])
_Met = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _searches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[dict, SortedLists, np.ndarray, np.ndarray, _Met]]:
    """The rows of block and queries that met, with the lists, the queries' ids and vectors, and what they found.  A block's rows come one after the other.

    The blocks searched so far raise the floors of the next ones.
    """
    last: tuple[int, int, SortedLists] | None = None
    best: dict[int, np.ndarray] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids, asking = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
            width = max(row["width"], row["query_width"])
            if last is None or last[:2] != (row["block"], width):
                last = row["block"], width, SortedLists(ids, _matrix(row["vectors"], len(ids), width))
            queries = _matrix(row["queries"], len(asking), width)
            so_far = best.get(row["asked"], np.full((len(asking), k), -np.inf))
            floors = np.maximum(np.frombuffer(row["floors"]) if row["floors"] else -np.inf, so_far.min(axis=1))
            found = block_top_k(last[2], asking, queries, k, floors)
            best[row["asked"]] = _best_scores(so_far, found)
            yield row, last[2], asking, queries, found


def _best_scores(so_far: np.ndarray, found: _Met) -> np.ndarray:
    """Each query's k best scores (a row per query, in any order) after one more block."""
    k = so_far.shape[1]
    at, _, scores, _ = found
    both = np.hstack([so_far, np.full_like(so_far, -np.inf)])
    both[at, k + np.arange(len(at)) - np.searchsorted(at, at)] = scores
    return np.partition(both, k, axis=1)[:, k:]


def _floors(asked: DataFrame, longest: DataFrame, k: int) -> DataFrame:
    """Query blocks with each query's k-th best score in ``longest``, the block of the longest vectors, and the vector length that the block's queries ask for at least."""
    # One block, BLOCK_ROWS rows at most, goes to every task.
    found = F.broadcast(longest.select(F.lit(0).alias("met"), "block", "ids", "vectors", "width"))
    unknown = asked.select(F.lit(0).alias("met"), F.col("block").alias("asked"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), F.col("width").alias("query_width"), F.lit(b"").alias("floors"))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, _, queries, (at, _, scores, _) in _searches(batches, k):
            floors = np.full(len(queries), -np.inf)
            last = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
            floors[at[last]] = scores[last]
            lengths = np.sqrt((queries * queries).sum(axis=1))
            reach = np.where(lengths > 0, floors / np.maximum(lengths, 1.0), -np.inf).min(initial=np.inf)
            yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in ("asked", "query_ids", "queries", "query_width")}, "floors": floors.tobytes(), "reach": float(reach)}], schema=_ARROW_ASKED)

    return settled(unknown.join(found, "met").mapInArrow(seek, _ASKED), "floors")


def _met(queries: DataFrame, candidates: DataFrame, k: int, identity: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Blocks next to the query blocks that may find something there, and the blocks.

    Blocks are dealt to tasks in turn, from the longest vectors to the shortest: each task gets as many as the others, of all lengths.
    """
    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(identity).cast("bigint").alias("id"), F.col(vector).alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull())

    lists = settled(_blocks(_falling(usable(candidates)), BLOCK_ROWS), "blocks")
    cores = lists.sparkSession.sparkContext.defaultParallelism
    blocks, first = lists.agg(F.count(F.lit(1)), F.coalesce(F.min("block"), F.lit(-1))).first()
    tasks = max(1, min(blocks, 3 * cores))
    # Query blocks come from few partitions, as they have few bytes, and cost a search each.
    asked = _floors(_blocks(_placed(usable(queries)).repartition("place"), QUERY_ROWS).repartition(cores), lists.filter(F.col("block") == first), k)
    # A row per part.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lists.groupBy("part").agg(F.count(F.lit(1)).alias("blocks")).select("part", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)).alias("before"))
    dealt = lists.join(F.broadcast(parts), "part").withColumn("task", ((F.col("before") + F.col("number")) % tasks).cast("int"))
    repeated = asked.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    within = F.col("longest") * (1 + _SLACK) >= F.col("reach")
    met = dealt.repartitionById(tasks, "task").join(repeated.repartitionById(tasks, "task").hint("shuffle_merge"), "task").filter(within)
    return met.select(*_SEARCHED), lists


def floored(vector: Column, factor: float = 256.0) -> Column:
    """Components times ``factor``, rounded down; null if the vector is null or holds a null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("double")))


def _mapped(met: DataFrame, k: int, schema: StructType, made: Callable[[np.ndarray, SortedLists, np.ndarray, _Met], list[pa.Array]]) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lists, asking, queries, found in _searches(batches, k):
            yield pa.RecordBatch.from_arrays(made(asking, lists, queries, found), names=schema.fieldNames())

    return met.mapInArrow(search, schema)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, identity: str = "vec_id", vector: str = "vector") -> DataFrame:
    """Rows (query_id, rank, identity, score): each query's ``k`` best candidates by inner product of whole-numbered vectors.

    Ties go to the smaller identity.  Rows with a null identity or vector take no part; shorter vectors end
    in zeros; a query never meets rows of its own identity; repeated rows count one by one.  Blocks and query blocks meet by
    a join on the task that searches the block; queries are repeated per task, since they are the smaller side.
    """
    schema = StructType([StructField("query_id", LongType()), StructField(identity, LongType()), StructField("score", LongType())])
    met, _ = _met(queries, candidates, k, identity, vector)
    found = _mapped(met, k, schema, lambda asking, lists, _, hits: [pa.array(asking[hits[0]]), pa.array(lists.ids[hits[1]]), pa.array(hits[2])])
    best = best_rows(found, ["query_id"], [F.col("score").desc(), F.col(identity)], k)
    return best.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), identity)).alias("rank"), identity, "score")


def read_shares(queries: DataFrame, candidates: DataFrame, k: int, identity: str = "vec_id", vector: str = "vector") -> DataFrame:
    """Rows (query_id, entries_read, entries): the list entries that ``top_k`` reads for each query after its floor is known, and all entries of the
    lists it gives weight to.  Queries that read nothing at all, and those that no block can serve, have no row or 0."""
    schema = StructType([StructField("query_id", LongType()), StructField("entries_read", LongType()), StructField("weights", LongType())])
    met, lists = _met(queries, candidates, k, identity, vector)
    rows = lists.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()["rows"]
    read = _mapped(met, k, schema, lambda asking, _, asked, hits: [pa.array(asking), pa.array(hits[3]), pa.array((asked != 0).sum(axis=1))])
    return read.groupBy("query_id").agg(F.sum("entries_read").alias("entries_read"), (F.max("weights") * F.lit(rows)).alias("entries"))
