"""Chat formatting with a loss mask aligned by offsets.

A conversation is rendered whole and encoded once.  The bytes of each token give its offset, and the sorted spans of the
turns under the loss are met with the sorted spans of the tokens by binary search.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from noticework.llm.common import fresh
from noticework.llm.packing import byte_bpe_50k

# The marks of a turn and the ids they get after the vocabulary.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
FIRST_MARK_ID = 50257
MARKS = (START, SEPARATOR, END)
LOSS_ROLES = ("assistant",)

# Bytes of rendered text that leave a task together.
_STRETCH = 8 << 20


def escaped(text: Column) -> Column:
    """No ``<|`` is left: between ``<`` and ``|`` stands one backslash more than before."""
    return F.regexp_replace(text, F.lit(r"<(\\*)\|"), F.lit(r"<$1\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\\(\\*)\|"), F.lit("<$1|"))


def turns_of(formatted: Column) -> Column:
    """Array of (role, text) read back from a rendered conversation."""
    pieces = F.split(formatted, START.replace("|", r"\|"))
    return F.transform(F.slice(pieces, 2, F.size(pieces)), lambda piece: F.struct(
        unescaped(F.substring_index(piece, SEPARATOR, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(piece, SEPARATOR, -1), END, 1)).alias("text")))


class Encoder:
    """Token ids of a rendered conversation, and the bytes that each id stands for.

    Texts that tiktoken gives up on, such as a million blanks in a row, are encoded by tokenizers from the same vocabulary.
    """

    def __init__(self, rank_file: str, pattern: str, special: Sequence[tuple[str, int]], whole_file: str):
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        marks = {**dict(special), **{mark: FIRST_MARK_ID + i for i, mark in enumerate(MARKS)}}
        self.fast = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=marks)
        self.whole_file, self.whole = whole_file, None
        self.sizes = np.zeros(max(marks.values()) + 1, np.int64)
        for token, i in [*ranks.items(), *((m.encode(), i) for m, i in marks.items())]:
            self.sizes[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.whole_file)
                self.whole.add_special_tokens(list(MARKS))
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def _encoder(*vocabulary) -> Encoder:
    return Encoder(*vocabulary)


def mask_tokens(ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token lies inside one of the spans.

    ``ends`` are the tokens' byte ends, rising; ``spans`` are rows (start, end), sorted and apart.  A token that reaches over the
    border of a span is outside; the template's marks stand at every border, so none does.
    """
    if not len(spans):
        return np.zeros(len(ends), bool)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    span = np.searchsorted(spans[:, 0], starts, side="right") - 1
    return (span >= 0) & (ends <= spans[np.maximum(span, 0), 1])


def runs_of(mask: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the unbroken runs of tokens under the mask."""
    edges = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    starts = np.concatenate(([0], ends))
    return list(zip(starts[np.flatnonzero(edges == 1)].tolist(), starts[np.flatnonzero(edges == -1)].tolist(), strict=True))


def _spans(lengths: Sequence[tuple[int, int, bool]]) -> np.ndarray:
    """(start, end) of the texts under the loss, from each turn's (bytes before its text, bytes of its text, under the loss)."""
    table = np.array(lengths, np.int64).reshape(-1, 3)
    tail = len(END.encode())
    whole = table[:, 0] + table[:, 1] + tail
    starts = np.cumsum(whole) - whole + table[:, 0]
    spans = np.stack([starts, starts + table[:, 1]], axis=1)
    return spans[(table[:, 2] == 1) & (table[:, 1] > 0)]


def format_conversations(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         loss_roles: Sequence[str] = LOSS_ROLES, vocabulary=byte_bpe_50k) -> DataFrame:
    """One row per conversation: ``formatted``, ``input_ids``, ``loss_mask`` (one flag per token) and ``loss_texts``.

    Turns stand in the order of ``turn``; equal turns by role and text, a null turn first.  Null roles and texts count as empty, rows
    without a conversation form one together.  ``loss_texts`` are the stretches under the mask, as they are rendered: one for each
    text of ``loss_roles`` that is not empty.  Texts are escaped, so whatever they hold, ``turns_of`` reads the same turns back.
    A conversation is one training sample and is rendered in one task; no task holds more than one beyond a few megabytes.
    """
    held = F.struct(F.col(turn).alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    grouped = rows.groupBy(conversation).agg(F.array_sort(F.collect_list(held)).alias("turns"))
    head = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), escaped(t["role"]), F.lit(SEPARATOR)).alias("head"), escaped(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss")))
    parts = fresh(rows, "turn_parts")
    drawn = grouped.select(conversation, head.alias(parts)).select(
        conversation, F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform(parts, lambda p: F.struct(F.octet_length(p["head"]).alias("before"), F.octet_length(p["body"]).alias("size"), p["loss"].alias("loss"))).alias("lengths"))
    schema = StructType([rows.schema[conversation], StructField("formatted", StringType()), StructField("input_ids", ArrayType(IntegerType())),
                         StructField("loss_mask", ArrayType(BooleanType())), StructField("loss_texts", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*vocabulary())
        for batch in batches:
            for piece in _stretches(batch):
                yield _encoded(piece, encoder, schema.fieldNames())

    return drawn.mapInArrow(run, schema)


def _stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows with a few megabytes of text, or one row."""
    sizes = pc.binary_length(batch.column(1).cast(pa.binary())).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > _STRETCH:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def _encoded(batch: pa.RecordBatch, encoder: Encoder, names: list[str]) -> pa.RecordBatch:
    ids, masks, texts = [], [], []
    for rendered, lengths in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        tokens = encoder.ids(rendered)
        ends = np.cumsum(encoder.sizes[tokens])
        mask = mask_tokens(ends, _spans([(x["before"], x["size"], x["loss"]) for x in lengths]))
        raw = rendered.encode()
        ids.append(tokens.astype(np.int32))
        masks.append(mask)
        texts.append([raw[a:b].decode() for a, b in runs_of(mask, ends)])
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        batch.column(0), batch.column(1), pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(ids))),
        pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(masks))), pa.array(texts, pa.list_(pa.string()))], names=names)
