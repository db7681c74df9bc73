"""Near duplicates by SimHash: popcount embedding, grid range join under Manhattan distance, exact check.

A fingerprint's segments are mapped to their numbers of set bits.  The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, so pairs within ``radius`` bits are
points within ``radius`` of each other.  The vector's coordinates are dealt into groups; two points
within the radius agree on all coordinates of all but ``radius`` groups at least, hence share a cell of
one of the grids that are made of that many groups.  Inside a cell the vectors' distance is checked, then the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from noticework.llm.common import as_bytes, fresh, with_arrow
from noticework.session import settled, spread_by

RADIUS = 3
SEGMENT_BITS = 2
GROUPS = 6
SHINGLE = 3
SEED = 42

_SEGMENTS = 64 // SEGMENT_BITS
_SMALL_CELL = 32


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of a whole text's word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    count = len(words) - SHINGLE + 1
    spans = zip(starts[:count].tolist(), ends[SHINGLE - 1:].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        block = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "fingerprint") -> DataFrame:
    """``keep`` (default all) columns of ``docs`` and the fingerprint as a signed long."""
    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in as_bytes(texts)], np.uint64).view(np.int64))]
    return with_arrow(docs, [text], StructType([StructField(name, LongType())]), compute, keep)


# ---------------------------------------------------------------- embedding and grids

def embed(prints: np.ndarray) -> np.ndarray:
    """Set bits of each segment, one row per fingerprint."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.reshape(len(prints), _SEGMENTS, SEGMENT_BITS).sum(axis=2, dtype=np.uint8)


def grid_cells(prints: np.ndarray, radius: int = RADIUS, groups: int = GROUPS) -> np.ndarray:
    """The cell of each fingerprint in each grid, as 64-bit keys; one column per grid.

    A coordinate takes part with its exact value: cells are one unit wide.
    """
    vectors = embed(prints).astype(np.uint64)
    bits = np.uint64(int(SEGMENT_BITS).bit_length())
    dealt = [range(g, _SEGMENTS, groups) for g in range(groups)]
    columns = []
    for grid, chosen in enumerate(combinations(range(groups), groups - radius)):
        key = np.full(len(prints), grid + 1, np.uint64)
        for segment in (s for g in chosen for s in dealt[g]):
            key = (key << bits | vectors[:, segment]) * np.uint64(0x9E3779B97F4A7C15) ^ (key >> np.uint64(37))
        columns.append(key.view(np.int64))
    return np.stack(columns, axis=1)


def _near(one: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """Manhattan distance of the embeddings as the lower bound, then the differing bits of what is left."""
    near = np.abs(embed(one).astype(np.int8) - embed(other).astype(np.int8)).sum(axis=1) <= radius
    near[near] = np.bitwise_count(one[near] ^ other[near]) <= radius
    return near


def _cell_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius in one large cell: a search tree, not all pairs.

    Each member is compared once with those not reached yet, so a dense cell costs little more than its size.
    """
    links = []
    rest = prints
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            centre = frontier.pop()
            near = _near(np.full(len(rest), centre, np.uint64), rest, radius)
            if near.any():
                reached = rest[near]
                links += [(int(centre), int(x)) for x in reached]
                frontier += list(reached)
                rest = rest[~near]
    return links


def _links_of_run(cells: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Links inside the cells of a sorted run; one pair of fingerprints per row."""
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.append(starts, len(cells)))
    found = []
    small = np.repeat((sizes > 1) & (sizes <= _SMALL_CELL), sizes)
    cells_small, prints_small = cells[small], prints[small]
    for step in range(1, min(_SMALL_CELL, len(cells_small))):
        same = np.flatnonzero(cells_small[step:] == cells_small[:-step])
        if not len(same):
            break
        one, other = prints_small[same], prints_small[same + step]
        near = _near(one, other, radius)
        found.append(np.stack([one[near], other[near]], axis=1))
    for start, size in zip(starts[sizes > _SMALL_CELL], sizes[sizes > _SMALL_CELL], strict=True):
        links = _cell_links(prints[start:start + size], radius)
        if links:
            found.append(np.array(links, np.uint64))
    return np.concatenate(found) if found else np.empty((0, 2), np.uint64)


def near_links(prints: DataFrame, name: str = "fingerprint", radius: int = RADIUS) -> DataFrame:
    """Rows (a, b), a < b: links between distinct fingerprints that connect all pairs within ``radius`` bits.

    ``prints`` holds distinct fingerprints.  Links that a cell's search tree does not need are left out.
    """
    cells_schema = StructType([StructField("cell", LongType()), StructField("print", LongType())])
    links_schema = StructType([StructField("a", LongType()), StructField("b", LongType())])

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            keys = grid_cells(values, radius)
            yield pa.RecordBatch.from_arrays([pa.array(keys.T.ravel()), pa.array(np.tile(values.view(np.int64), keys.shape[1]))], names=["cell", "print"])

    def to_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit(cells: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            links = _links_of_run(cells, values.view(np.uint64), radius).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(links.min(axis=1)), pa.array(links.max(axis=1))] if len(links) else
                                              [pa.array([], pa.int64()), pa.array([], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if held[0][0][0] == held[-1][0][-1]:
                continue  # still inside one cell
            cells, values = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(cells, cells[-1]))
            held = [(cells[cut:], values[cut:])]
            yield emit(cells[:cut], values[:cut])
        if held:
            yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    cells = prints.select(name).mapInArrow(to_cells, cells_schema)
    return spread_by(cells, "cell").sortWithinPartitions("cell", "print").mapInArrow(to_links, links_schema).distinct()


# ---------------------------------------------------------------- components

def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Rows (node, root): the smallest node reachable from each node that has a link.

    Alternating star steps: every node hands its larger neighbours, then its smaller ones, to the
    smallest it knows.  Each step is an aggregation and a join on written tables; links never meet in one place.
    """
    edges = settled(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settled(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = settled(small, "links")
        new = _state(edges)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("links did not settle")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def near_duplicates(docs: DataFrame, identity: str = "doc_id", text: str = "text", keep: list[str] | None = None,
                    fingerprint_name: str = "fingerprint", component: str = "component_id", radius: int = RADIUS,
                    root_name: str | None = None) -> DataFrame:
    """``keep`` (default all) columns of ``docs``, the fingerprint (signed long) and the smallest identity reachable.

    Documents link at ``radius`` or fewer differing bits.  Null, empty and wordless texts have
    fingerprint zero and link like any other.  Rows of one identity are separate documents; a null identity is only
    a component's smallest if it has no other.  Fingerprints are written down once.  ``root_name`` adds a column that
    differs between any two components, also where missing or repeated identities make their smallest ones equal.
    """
    marked = settled(with_fingerprints(docs, text, list(dict.fromkeys([identity, *(docs.columns if keep is None else keep)])), fingerprint_name), "prints")
    firsts = settled(marked.groupBy(fingerprint_name).agg(F.min(identity).alias("first")), "classes")
    roots = components(near_links(firsts, fingerprint_name, radius))
    root = fresh(marked, "root")
    rooted = firsts.join(roots.withColumnRenamed("node", fingerprint_name), fingerprint_name, "left").withColumn("root", F.coalesce("root", fingerprint_name))
    smallest = rooted.groupBy("root").agg(F.min("first").alias(component))
    own_root = fresh(marked, "component_root")
    classes = rooted.join(smallest, "root").select(F.col(fingerprint_name).alias(root), component, F.col("root").alias(own_root))
    kept = list(docs.columns if keep is None else keep)
    return (marked.drop(*([component] if component not in kept else []))
            .join(classes.withColumnRenamed(component, fresh(marked, component)), F.col(fingerprint_name) == F.col(root))
            .select(*kept, fingerprint_name, F.col(fresh(marked, component)).alias(component), *([F.col(own_root).alias(root_name)] if root_name else [])))
