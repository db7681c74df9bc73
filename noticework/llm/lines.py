"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

A line's key is a 128-bit hash of the stripped, lower-cased line.  The exact tables hold every
(key, document) reference and, per key, the number of references and the smallest document.
Cuckoo filters, one chain per shard of the keys, answer most questions without them: a key that the
``known`` filter lacks is new and needs no merge; a line that the ``repeated`` filter lacks is unique.
Both support deletion, so taking documents out restores what was there before.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from noticework.llm.common import as_bytes, fresh, in_small_batches, with_arrow
from noticework.session import scratch_path, settled

MIN_CHARS = 10
# Filters up to this many bytes in all go to every task; to larger ones the keys are sent by shard.
BROADCAST_BYTES = 32 << 20
# Text of a shard: a key takes ten bytes and a line end at least, so this bounds its keys, however long the documents are.
BYTES_PER_SHARD = 4 << 20
KEY_BYTES = 16
# Stands for a missing document number: one document, after all others.
NO_ID = (1 << 63) - 1


# ---------------------------------------------------------------- cuckoo filters

class CuckooFilter:
    """Buckets of four 16-bit fingerprints; each key may lie in one of two buckets."""

    SLOTS = 4
    MAX_KICKS = 200

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, self.SLOTS), np.uint16) if slots is None else slots

    @staticmethod
    def sized(keys: int) -> CuckooFilter:
        return CuckooFilter(1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (CuckooFilter.SLOTS * 0.85))))))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (hashes & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, ((hashes >> np.uint64(16)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        return buckets ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def _settle(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Put what finds a free slot; which rows still wait."""
        waiting = np.ones(len(prints), bool)
        for slot in range(self.SLOTS):
            rows = np.flatnonzero(waiting)
            rows = rows[self.slots[buckets[rows], slot] == 0]
            _, first = np.unique(buckets[rows], return_index=True)
            rows = rows[first]
            self.slots[buckets[rows], slot] = prints[rows]
            waiting[rows] = False
        return waiting

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Add keys; returns the fingerprints' (print, bucket) pairs that found no place, as rows."""
        prints, buckets = self._places(hashes)
        waiting = self._settle(prints, buckets)
        prints, buckets = prints[waiting], self._other(prints[waiting], buckets[waiting])
        for kick in range(self.MAX_KICKS):
            if not len(prints):
                break
            waiting = self._settle(prints, buckets)
            prints, buckets = prints[waiting], buckets[waiting]
            if not len(prints):
                break
            _, first = np.unique(buckets, return_index=True)
            slot = (first + kick) % self.SLOTS
            evicted = self.slots[buckets[first], slot].copy()
            self.slots[buckets[first], slot] = prints[first]
            prints[first] = evicted
            buckets[first] = self._other(evicted, buckets[first])
        return np.stack([prints.astype(np.int64), buckets], axis=1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, buckets = self._places(hashes)
        hit = (self.slots[buckets] == prints[:, None]).any(axis=1)
        return hit | (self.slots[self._other(prints, buckets)] == prints[:, None]).any(axis=1)

    def remove(self, hashes: np.ndarray) -> np.ndarray:
        """Remove one copy of each key; returns which were there."""
        prints, one = self._places(hashes)
        gone = np.zeros(len(hashes), bool)
        for row, (mark, buckets) in enumerate(zip(prints.tolist(), np.stack([one, self._other(prints, one)], axis=1).tolist(), strict=True)):
            for bucket in buckets:
                at = np.flatnonzero(self.slots[bucket] == mark)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    gone[row] = True
                    break
        return gone


class CuckooChain:
    """Cuckoo filters that grow: what the last one cannot hold goes to a new one."""

    def __init__(self, filters: list[CuckooFilter] | None = None):
        self.filters = filters or []
        # Fingerprints thrown out of a full filter: (filter, print, bucket) rows, always few.
        self.stray: list[tuple[int, int, int]] = []

    def add(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        if not self.filters or np.count_nonzero(self.filters[-1].slots) + len(hashes) > 0.9 * self.filters[-1].slots.size:
            self.filters.append(CuckooFilter.sized(len(hashes)))
        level = len(self.filters) - 1
        self.stray += [(level, int(p), int(b)) for p, b in self.filters[-1].add(hashes)]

    def _stray_rows(self, level: int, hashes: np.ndarray) -> np.ndarray:
        cuckoo = self.filters[level]
        prints, buckets = cuckoo._places(hashes)
        other = cuckoo._other(prints, buckets)
        kept = {(p, b) for at, p, b in self.stray if at == level}
        return np.array([(int(p), int(x)) in kept or (int(p), int(y)) in kept for p, x, y in zip(prints, buckets, other, strict=True)], bool)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(hashes), bool)
        for level, cuckoo in enumerate(self.filters):
            hit |= cuckoo.contains(hashes)
            if any(at == level for at, _, _ in self.stray):
                hit |= self._stray_rows(level, hashes)
        return hit

    def remove(self, hashes: np.ndarray) -> None:
        """Remove keys that were added: exact tables say so, or another key's fingerprint could go."""
        for level in range(len(self.filters) - 1, -1, -1):
            if not len(hashes):
                return
            gone = self.filters[level].remove(hashes)
            for row in np.flatnonzero(~gone):
                prints, buckets = self.filters[level]._places(hashes[row:row + 1])
                for bucket in (int(buckets[0]), int(self.filters[level]._other(prints, buckets)[0])):
                    if (level, int(prints[0]), bucket) in self.stray:
                        self.stray.remove((level, int(prints[0]), bucket))
                        gone[row] = True
                        break
            hashes = hashes[~gone]

    def pack(self) -> bytes:
        head = struct.pack("<II", len(self.filters), len(self.stray))
        body = b"".join(struct.pack("<Q", f.buckets) + f.slots.tobytes() for f in self.filters)
        return head + body + np.array(self.stray, np.int64).tobytes()

    @staticmethod
    def unpack(data: bytes | None) -> CuckooChain:
        chain = CuckooChain()
        if data is None:
            return chain
        filters, stray = struct.unpack_from("<II", data)
        at = 8
        for _ in range(filters):
            (buckets,) = struct.unpack_from("<Q", data, at)
            size = buckets * CuckooFilter.SLOTS
            chain.filters.append(CuckooFilter(buckets, np.frombuffer(data, np.uint16, size, at + 8).reshape(buckets, -1).copy()))
            at += 8 + 2 * size
        chain.stray = [tuple(x) for x in np.frombuffer(data, np.int64, 3 * stray, at).reshape(-1, 3).tolist()]
        return chain


# ---------------------------------------------------------------- lines of texts

def line_key(line: bytes) -> bytes | None:
    """128-bit key of a line, or None for keys of fewer than ``MIN_CHARS`` code points."""
    stripped = line.strip()
    if len(stripped) < MIN_CHARS or (len(stripped) < 4 * MIN_CHARS and len(stripped.decode(errors="replace")) < MIN_CHARS):
        return None
    return xxhash.xxh3_128_digest(stripped.lower())


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2] if keys else np.empty(0, np.uint64)


def _column_hashes(keys: pa.ChunkedArray) -> np.ndarray:
    """The same of a column of keys, without an object per key."""
    parts = [np.frombuffer(pa.concat_arrays([chunk.cast(pa.binary(KEY_BYTES))]).buffers()[1], np.uint64, 2 * len(chunk), KEY_BYTES * chunk.offset)[::2]
             for chunk in keys.chunks if len(chunk)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % shards


def _chain_of(filters: pa.Table, kind: str) -> CuckooChain:
    """The chain of one kind among a shard's filters; an empty one if it has none."""
    found = [data for name, data in zip(filters.column("kind").to_pylist(), filters.column("filter").to_pylist(), strict=True) if name == kind]
    return CuckooChain.unpack(found[0] if found else None)


_REFERENCE = StructType([StructField("shard", LongType()), StructField("key", BinaryType()), StructField("doc", LongType())])


def _references(docs: DataFrame, document: Column, text: str, shards: int, filters=None) -> DataFrame:
    """Rows (shard, key, doc), once per key and row; with ``filters`` only for lines that may be repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = None if filters is None else {s: CuckooChain.unpack(b) for s, b in filters.value.items()}
        for batch in batches:
            keys, rows = [], []
            for row, value in enumerate(as_bytes(batch.column(1))):
                found = {line_key(x) for x in (value or b"").split(b"\n")}
                found.discard(None)
                keys += found
                rows += [row] * len(found)
            hashes = _hashes(keys)
            shard = shard_of(hashes, shards)
            wanted = np.ones(len(keys), bool)
            if chains is not None:
                wanted[:] = False
                order = np.argsort(shard, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                    chain = chains.get(int(shard[part[0]]))
                    if chain is not None:
                        wanted[part] = chain.contains(hashes[part])
            chosen = np.flatnonzero(wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[chosen]), pa.array([keys[i] for i in chosen], pa.binary()), batch.column(0).take(pa.array(np.array(rows, np.int64)[chosen]))],
                names=["shard", "key", "doc"])

    return in_small_batches(docs.select(document.alias("doc"), text)).mapInArrow(run, _REFERENCE)


# ---------------------------------------------------------------- the store

class LineStore:
    """Which lines occur in which documents, as tables below a folder of the shared file system.

    ``insert`` and ``delete`` each write a new version and leave the last one as it is, so a failed or repeated step harms
    nothing.  Inserting a document twice changes nothing.  ``clean`` may be asked for any documents.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int = 16, identity: str = "doc_id", text: str = "text"):
        self.spark, self.shards, self.identity, self.text = spark, shards, identity, text
        self.folder = folder or scratch_path(spark, "lines")
        self.version = 0

    def _document(self) -> Column:
        return F.coalesce(F.col(self.identity).cast("bigint"), F.lit(NO_ID))

    def _read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/{self.version}/{name}") if self.version else None

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.version + 1}/{name}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def insert(self, docs: DataFrame) -> LineStore:
        """Take in the lines of ``docs``."""
        batch = _references(docs, self._document(), self.text, self.shards).distinct()
        old_references, old_keys, old_filters = (self._read(x) for x in ("references", "keys", "filters"))
        if old_references is not None:
            # The filter names the keys that may be known; only their references can be there already.
            batch = self._write("batch", batch)
            maybe = self._flag(batch.select("shard", "key").distinct(), old_filters)
            flagged = batch.join(maybe, ["shard", "key"])
            again = flagged.filter("maybe").drop("maybe").join(old_references, ["shard", "key", "doc"], "left_anti")
            batch = flagged.filter(~F.col("maybe")).drop("maybe").unionByName(again)
        references = self._write("references" if old_references is None else "added", batch)
        added = references.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc").alias("first"))
        if old_keys is None:
            keys = self._write("keys", added)
            changes = keys.select("shard", "key", F.lit(True).alias("known"), (F.col("refs") > 1).alias("repeated"))
        else:
            before = old_keys.select("shard", "key", F.col("refs").alias("old_refs"), F.col("first").alias("old_first"))
            merged = self._write("touched", added.join(before, ["shard", "key"], "left").select(
                "shard", "key", (F.col("refs") + F.coalesce("old_refs", F.lit(0))).alias("refs"), F.least("first", "old_first").alias("first"),
                F.coalesce("old_refs", F.lit(0)).alias("old_refs")))
            self._write("keys", old_keys.join(merged, ["shard", "key"], "left_anti").unionByName(merged.drop("old_refs")))
            changes = merged.select("shard", "key", F.when(F.col("old_refs") == 0, True).alias("known"),
                                    F.when((F.col("old_refs") < 2) & (F.col("refs") > 1), True).alias("repeated"))
            self._write("references", old_references.unionByName(references))
        self._write("filters", self._changed(changes, old_filters))
        self.version += 1
        return self

    def delete(self, documents: DataFrame) -> LineStore:
        """Take out all lines of the documents whose numbers ``documents`` holds in the identity column."""
        references, keys, filters = (self._read(x) for x in ("references", "keys", "filters"))
        if references is None:
            return self
        gone = documents.select(self._document().alias("doc")).distinct()
        removed = self._write("removed", references.join(gone, "doc").select("shard", "key", "doc"))
        left = self._write("references", references.join(gone, "doc", "left_anti").select("shard", "key", "doc"))
        touched = removed.select("shard", "key").distinct()
        recounted = left.join(touched, ["shard", "key"], "left_semi").groupBy("shard", "key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc").alias("first"))
        before = keys.join(touched, ["shard", "key"], "left_semi").select("shard", "key", F.col("refs").alias("old_refs"))
        recounted = self._write("touched", before.join(recounted, ["shard", "key"], "left"))
        self._write("keys", keys.join(touched, ["shard", "key"], "left_anti").unionByName(recounted.filter(F.col("refs") > 0).select("shard", "key", "refs", "first")))
        now = F.coalesce("refs", F.lit(0))
        changes = recounted.select("shard", "key", F.when(now == 0, False).alias("known"), F.when((F.col("old_refs") > 1) & (now < 2), False).alias("repeated"))
        self._write("filters", self._changed(changes, filters))
        self.version += 1
        return self

    def _flag(self, keys: DataFrame, filters: DataFrame, kind: str = "known") -> DataFrame:
        """``keys`` with ``maybe``: false where the shard's filter proves that a key is not of this kind."""
        schema = StructType([*_REFERENCE.fields[:2], StructField("maybe", BooleanType())])

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            maybe = _chain_of(right, kind).contains(_column_hashes(left.column("key")))
            return pa.table([left.column("shard"), left.column("key"), pa.array(maybe, pa.bool_())], names=schema.fieldNames())
        return keys.select("shard", "key").groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(probe, schema)

    def _changed(self, changes: DataFrame, filters: DataFrame | None) -> DataFrame:
        """Filters after adding (true) and removing (false) keys; a shard's distinct keys meet in one task."""
        schema = StructType([StructField("shard", LongType()), StructField("kind", StringType()), StructField("filter", BinaryType())])
        old = self.spark.createDataFrame([], schema) if filters is None else filters

        def update(left: pa.Table, right: pa.Table) -> pa.Table:
            shard = (left if len(left) else right).column("shard")[0].as_py()
            chains = []
            for kind in ("known", "repeated"):
                chain = _chain_of(right, kind)
                marks = left.column(kind)
                chain.remove(_column_hashes(left.column("key").filter(pc.equal(marks, False))))
                chain.add(_column_hashes(left.column("key").filter(marks)))
                chains.append(chain.pack())
            return pa.table([pa.array([shard] * 2), pa.array(["known", "repeated"]), pa.array(chains, pa.binary())], names=schema.fieldNames())

        moved = changes.filter(F.col("known").isNotNull() | F.coalesce("repeated", F.lit(False)) | ~F.coalesce("repeated", F.lit(True)))
        return moved.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(update, schema)

    def repeated(self) -> DataFrame:
        """Rows (key, first): keys that two or more documents hold, and the smallest of these."""
        return self._read("keys").filter(F.col("refs") > 1).select("key", "first")

    def _broadcast_filters(self):
        held = self._read("filters").filter(F.col("kind") == "repeated")
        size = held.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
        if size > BROADCAST_BYTES:
            return None
        return self.spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in held.select("shard", "filter").collect()})

    def clean(self, docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
        """``docs`` without lines that an earlier document holds, with the lines before and the lines dropped.

        Null and empty texts are one empty line and come back empty.  Columns of ``docs`` with the
        names of the counts are replaced.
        """
        filters = self._broadcast_filters()
        maybe = _references(docs, self._document(), self.text, self.shards, filters).distinct()
        if filters is None:  # too many to send them all: every shard's keys go to its own filter
            maybe = settled(maybe, "asked")
            hits = self._flag(maybe.select("shard", "key").distinct(), self._read("filters"), "repeated").filter("maybe")
            maybe = maybe.join(hits.select("shard", "key"), ["shard", "key"], "left_semi")
        drops = maybe.join(self.repeated(), "key").filter(F.col("first") != F.col("doc")).groupBy("doc").agg(F.collect_list("key").alias("keys"))
        own, keys = fresh(docs, "line_doc"), fresh(docs, "line_keys")
        joined = docs.withColumn(own, self._document()).join(drops.select(F.col("doc").alias(own), F.col("keys").alias(keys)), own, "left")
        counted = {n_lines.lower(), n_dropped.lower()}
        kept = [c for c in docs.columns if c.lower() not in counted and c != self.text]
        outputs = StructType([StructField(self.text, StringType()), StructField(n_lines, LongType()), StructField(n_dropped, LongType())])
        done = with_arrow(joined, [self.text, keys], outputs, _without_lines, kept)
        return done.select(*(c for c in docs.columns if c.lower() not in counted), n_lines, n_dropped)


def _without_lines(texts: pa.Array, keys: pa.Array) -> list[pa.Array]:
    out, before, dropped = [], [], []
    for text, drop in zip(as_bytes(texts), keys.to_pylist(), strict=True):
        lines = (text or b"").split(b"\n")
        before.append(len(lines))
        if drop:
            unwanted = set(drop)
            lines = [x for x in lines if line_key(x) not in unwanted]
        out.append(b"\n".join(lines))
        dropped.append(before[-1] - len(lines))
    return [pa.array(out, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())]


def dedup_lines(docs: DataFrame, identity: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` cleaned of lines that a document with a smaller number holds; see ``LineStore.clean``."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(16, size // BYTES_PER_SHARD)
    return LineStore(docs.sparkSession, shards=shards, identity=identity, text=text).insert(docs).clean(docs, n_lines, n_dropped)
