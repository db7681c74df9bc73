"""Packing of token sequences: dominance reduction, then best fit.

Only lengths matter for packing, and there are at most ``capacity`` of them.  So the driver plans on
a histogram: sets that provably dominate every alternative are fixed for as many copies as there are,
the rest is packed best fit by falling length.  Spark numbers the pieces of each length and looks up their places.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from noticework.llm.common import in_small_batches
from noticework.session import settled

CAPACITY = 1024
END_ID = 2

Pattern = tuple[int, ...]


# ---------------------------------------------------------------- tokens

class _Encoder:
    """tiktoken's ids; texts that it gives up on, such as a million blanks in a row, are encoded from the tokenizers file instead."""

    def __init__(self, rank_file: str, pattern: str, special: tuple[tuple[str, int], ...], whole_file: str | None):
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
        self.whole_file = whole_file

    def encode_to_numpy(self, text: str, allowed_special="all") -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=allowed_special)
        except ValueError:
            if self.whole_file is None:
                raise
            return np.array(_whole(self.whole_file).encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def _whole(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _encoder(rank_file: str, pattern: str, special: tuple[tuple[str, int], ...], whole_file: str | None = None) -> _Encoder:
    return _Encoder(rank_file, pattern, special, whole_file)


def byte_bpe_50k() -> tuple[str, str, tuple[tuple[str, int], ...], str]:
    """Vocabulary of ``byte_bpe_50k.json`` as ranks, which give the same ids in a fifth of the time, and that file itself."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),), public_tokenizers.path("byte_bpe_50k.json")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a shorter first one if need be."""
    first = length % capacity
    starts = [0] * (first > 0) + list(range(first, length, capacity))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], length], strict=True)]


def pieces(docs: DataFrame, identity: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer=byte_bpe_50k) -> DataFrame:
    """Rows (identity, piece, start, length, ids_crc32) of every document; a null text is an empty one."""
    schema = StructType([StructField(identity, docs.schema[identity].dataType), StructField("piece", IntegerType()), *(
        StructField(c, LongType()) for c in ("start", "length", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*tokenizer())
        for batch in batches:
            rows, values = [], []
            for row, value in enumerate(batch.column(1)):
                ids = np.append(encoder.encode_to_numpy(value.as_py() or "", allowed_special="all"), END_ID).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append(row)
                    values.append((k, start, length, zlib.crc32(ids[start:start + length].tobytes())))
            table = np.array(values, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, j]) for j in (1, 2, 3))],
                names=schema.fieldNames())

    return in_small_batches(docs.select(identity, text)).mapInArrow(run, schema)


# ---------------------------------------------------------------- the plan

class _Lengths:
    """Counts per length, with the neighbours a reduction asks for."""

    def __init__(self, counts: dict[int, int]):
        self.left = Counter({s: n for s, n in counts.items() if n > 0})
        self.sizes = sorted(self.left)

    def without(self, item: int) -> list[int]:
        """Available lengths in rising order once one copy of ``item`` is set aside."""
        return [s for s in self.sizes if self.left[s] > (s == item)]

    def take(self, pattern: Pattern) -> int:
        """Take the pattern as often as the counts allow."""
        need = Counter(pattern)
        times = min(self.left[s] // n for s, n in need.items())
        for s, n in need.items():
            self.left[s] -= times * n
            if not self.left[s]:
                del self.left[s]
                self.sizes.remove(s)
        return times

    def copies(self, size: int, item: int) -> int:
        return self.left[size] - (size == item)


def dominating_set(lengths: _Lengths, item: int, capacity: int) -> Pattern | None:
    """A set with ``item`` that dominates every feasible set with it, if one of up to three pieces does.

    A set dominates another if the other's pieces can be grouped so that each group fits in the place of one of its own pieces.
    """
    room = capacity - item
    others = [s for s in lengths.without(item) if s <= room]
    if not others:
        return (item,)
    partner = others[-1]
    smallest = [s for s in others[:3] for _ in range(min(3, lengths.copies(s, item)))][:3]
    if partner == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (item, partner)
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    # At most two more pieces fit: the fullest pair decides.
    best = (0, 0, 0)
    high = len(others) - 1
    for low, a in enumerate(others):
        while high >= low and a + others[high] > room:
            high -= 1
        b = high
        if b == low and lengths.copies(a, item) < 2:
            b -= 1
        if b < low:
            break
        best = max(best, (a + others[b], a, others[b]))
    total, a, b = best
    if partner >= total:
        return (item, partner)
    above = [s for s in others if s > a]
    if b == partner and (not above or 2 * above[0] > room):
        return (item, a, b)
    return None


def reduce_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed patterns with their numbers of copies, and the counts that no rule settles.

    Each fixed set dominates its alternatives, so some best packing contains it.  Taking pieces away
    never undoes a rule, so a set is fixed for all copies at once.
    """
    lengths = _Lengths(counts)
    fixed = []
    progress = True
    while progress:
        progress = False
        for item in list(reversed(lengths.sizes)):
            while lengths.left[item]:
                pattern = dominating_set(lengths, item, capacity)
                if pattern is None:
                    break
                fixed.append((pattern, lengths.take(pattern)))
                progress = True
    return fixed, dict(lengths.left)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Best fit by falling length: each piece goes to the fullest open sequence that holds it.

    Sequences with the same pieces are one group with a number of copies; equal pieces are placed together.
    """
    open_groups: dict[int, list[tuple[Pattern, int]]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_groups if r >= size):
            each = room // size
            groups = open_groups.pop(room)
            while groups and left >= 1:
                pattern, copies = groups.pop()
                full = min(copies, left // each)
                if full:
                    open_groups.setdefault(room - each * size, []).append((pattern + (size,) * each, full))
                    left -= full * each
                if copies > full:
                    if left and left < each:
                        open_groups.setdefault(room - left * size, []).append((pattern + (size,) * left, 1))
                        left, full = 0, full + 1
                    if copies > full:
                        groups.append((pattern, copies - full))
            if groups:
                open_groups.setdefault(room, []).extend(groups)
            if not left:
                break
        each = capacity // size
        if left >= each:
            open_groups.setdefault(capacity - each * size, []).append(((size,) * each, left // each))
        if left % each:
            open_groups.setdefault(capacity - left % each * size, []).append(((size,) * (left % each), 1))
    return [group for groups in open_groups.values() for group in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns of lengths with their numbers of copies, holding every piece exactly once."""
    fixed, rest = reduce_lengths(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[tuple[Pattern, int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For each slot of each pattern: length, first rank it serves, first sequence, offset; sorted for search."""
    served: Counter[int] = Counter()
    slots = []
    sequence = 0
    for pattern, copies in patterns:
        offset = 0
        for size in pattern:
            slots.append((size, served[size], sequence, offset))
            served[size] += copies
            offset += size
        sequence += copies
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


# ---------------------------------------------------------------- the operator

def pack(docs: DataFrame, identity: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer=byte_bpe_50k) -> DataFrame:
    """Rows (identity, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    Empty and null texts hold the end id alone.  Repeated rows are packed like any others, a null
    identity too.  An empty table gives an empty result.  Other columns of ``docs`` are not read.
    """
    cut_up = settled(pieces(docs, identity, text, capacity, tokenizer), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes, ranks, sequences, offsets = _places(plan(counts, capacity), capacity)
    base = np.int64(1 << 44)
    keys = sizes * base + ranks
    numbered = number_within(cut_up, "length", [identity, "piece", "ids_crc32"], sum(counts.values()))
    schema = StructType([*cut_up.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    names = [f.name for f in cut_up.schema.fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(len(names)).to_numpy()
            slot = np.searchsorted(keys, batch.column(names.index("length")).to_numpy() * base + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(sequences[slot] + rank - ranks[slot]), pa.array(offsets[slot])],
                names=schema.fieldNames())

    return numbered.select(*names, "rank").mapInArrow(place, schema)


def number_within(rows: DataFrame, group: str, order: list[str], total: int) -> DataFrame:
    """``rows`` with ``rank``: 0, 1, ... inside each group.  Groups are numbered in hashed buckets, so a hot one is not sorted in one task.

    With the square root of all rows as the number of buckets, neither a bucket nor the list of a group's buckets grows large.
    """
    buckets = max(1, math.isqrt(total))
    split = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = split.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(*order)) - 1
    return (split.withColumn("inside", inside).join(sizes.select(group, "bucket", before.alias("before")), [group, "bucket"])
            .withColumn("rank", (F.col("before") + F.col("inside")).cast("bigint")).drop("bucket", "inside", "before"))
