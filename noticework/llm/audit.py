"""How filters overlap: every order of the filters at once, from counts per failing set.

What an order of filters removes depends only on which filters each document fails.  So documents are counted per part and
failing set, and each such cell is folded over the array of all orders by higher-order functions; the cells of a part
are added element by element.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from noticework.llm.common import fresh, with_arrow

# Fixed values of the five filters A to E: least words, least percentage of distinct words, highest percentage of
# capitals, characters that a text must not hold; E fails repeats of an earlier document.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
CAPITALS, FORBIDDEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]

_CONTINUATION = bytes(range(0x80, 0xC0))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_STRIDE = 1 << 20


def _word_counts(raw: bytes) -> tuple[int, int]:
    """Words and distinct words, a stretch of a long text at a time."""
    words, distinct, start = 0, set(), 0
    while start < len(raw):
        end = _BLANK.search(raw, min(start + _STRIDE, len(raw)))
        stop = end.start() if end else len(raw)
        found = raw[start:stop].split()
        words += len(found)
        distinct.update(found)
        start = stop + (stop == start)
    return words, len(distinct)


def text_failures(raw: bytes) -> str:
    """Letters of the filters A to D that a text fails."""
    words, distinct = _word_counts(raw)
    points = len(raw.translate(None, _CONTINUATION))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    failed = (words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * capitals > MAX_CAPITAL_PERCENT * points,
              len(raw.translate(None, FORBIDDEN)) < len(raw))
    return "".join(letter for letter, fails in zip(FILTERS, failed, strict=False) if fails)


def _failures_and_digests(texts: pa.Array) -> list[pa.Array]:
    raw = [x.as_py() or b"" for x in texts.cast(pa.binary())]
    return [pa.array([text_failures(x) for x in raw], pa.string()), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())]


def failing_sets(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Cells (part, fails, n, good, toxic): documents per part and set of failed filters, those of quality 1, those toxic.

    A null text is an empty one, a null part the empty part.  Repeats are found by SHA-256 over the whole table; rows of the
    smallest key are no repeats, rows without key neither are nor make any.  A key with several labels counts
    as good or toxic if one of them says so.  Copies are added up before they meet, so a text that a third of all rows
    hold arrives as a few rows.
    """
    marks = fresh(docs, "fails"), fresh(docs, "digest")
    outputs = StructType([StructField(marks[0], StringType()), StructField(marks[1], BinaryType())])
    judged = with_arrow(docs.select(key, part, text), [text], outputs, _failures_and_digests, [key, part]).select(
        F.col(key).alias("key"), F.coalesce(part, F.lit("")).alias("part"), F.col(marks[0]).alias("fails"), F.col(marks[1]).alias("digest"))
    said = labels.groupBy(F.col(key).alias("key")).agg(*(
        F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    labelled = judged.join(said, "key", "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "part", "fails", "good", "toxic"]
    rows = labelled.groupBy(*kind, "key").agg(F.count(F.lit(1)).alias("n"))
    copies = rows.groupBy(*kind, F.col("key").isNull().alias("unnumbered")).agg(F.sum("n").alias("n"), F.min(F.struct("key", "n")).alias("first"))
    lowest = F.min("first.key").over(Window.partitionBy("digest"))
    spared = F.when(F.col("unnumbered"), F.col("n")).when(F.col("first.key") == F.col("lowest"), F.col("first.n")).otherwise(0)
    split = copies.withColumn("lowest", lowest).select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("fails"), spared.alias("n")), F.struct(F.concat("fails", F.lit("E")).alias("fails"), (F.col("n") - spared).alias("n")))))
    return split.filter("n > 0").groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def all_orders(filters: Sequence[str] = FILTERS) -> Column:
    """Array of all orders of the filters, one letter each: a constant that goes to the tasks with the plan."""
    return F.split(F.lit(" ".join("".join(p) for p in permutations(filters))), " ")


def _cell_steps(cell: Column, orders: Column, filters: Sequence[str]) -> Column:
    """A cell's part of every count, as an array of structs: all steps of the first order, then of the second, and so on."""
    zero = F.lit(0).cast("bigint")

    def along(order: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            letter = order.substr(k, F.lit(1))
            fails, gone = F.instr(cell["fails"], letter) > 0, state["gone"]
            here = fails & ~gone
            made = F.struct(
                order.alias("filter_order"), k.alias("step"), F.when(gone | fails, zero).otherwise(cell["n"]).alias("kept"),
                F.when(here, cell["n"]).otherwise(zero).alias("removed"), F.when(fails & gone, cell["n"]).otherwise(zero).alias("redundant"),
                F.when(cell["fails"] == letter, cell["n"]).otherwise(zero).alias("unique_fails"),
                F.when(here, cell["good"]).otherwise(zero).alias("good_lost"), F.when(here, cell["toxic"]).otherwise(zero).alias("toxic_lost"))
            return F.struct((gone | fails).alias("gone"), F.concat(state["made"], F.array(made)).alias("made"))

        kind = "array<struct<filter_order:string,step:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
        start = F.struct(F.lit(False).alias("gone"), F.array().cast(kind).alias("made"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(filters))), start, step, lambda state: state["made"])

    return F.flatten(F.transform(orders, along))


def _added(left: Column, right: Column) -> Column:
    """Two arrays of steps added element by element."""
    return F.zip_with(left, right, lambda a, b: F.struct(
        a["filter_order"].alias("filter_order"), a["step"].alias("step"), *((a[c] + b[c]).alias(c) for c in COUNTS)))


def _removed_by(steps: str, letter: str) -> Column:
    """What one filter removes in all steps together."""
    own = F.filter(steps, lambda s: s["filter_order"].substr(s["step"], F.lit(1)) == letter)
    return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, s: total + s["removed"])


def interaction_audit(cells: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """Rows (part, filter_order, step, counts, shapley) for every order of the filters, zeros included.

    ``cells`` has part, fails (letters of the failed filters in rising order), n, good and toxic, one row per part and failing
    set; a part has 2 ** len(filters) cells at most, so its list is short whatever the documents.  ``shapley`` is what the step's
    filter removes, summed over all orders.  No cells give no rows.
    """
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    folded = parts.select("part", F.transform("cells", lambda c: _cell_steps(c, all_orders(filters), filters)).alias("steps"))
    merged = folded.select("part", F.aggregate(F.slice("steps", 2, F.size("steps")), F.col("steps")[0], _added).alias("steps"))
    removed = F.map_from_arrays(F.array(*map(F.lit, filters)), F.array(*(_removed_by("steps", letter) for letter in filters)))
    rows = merged.select("part", removed.alias("by_filter"), F.inline("steps"))
    return rows.select("part", "filter_order", "step", *COUNTS, F.col("by_filter")[F.col("filter_order").substr(F.col("step"), F.lit(1))].alias("shapley"))
