"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent and normalised; the exponent is bisected until the mix
reaches a target entropy or keeps within a repetition limit.  The weights become token budgets: whole passes
over a source, then a part of one more pass.  Each pass visits the source's blocks in its own keyed order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticework.llm.common import fresh, word_count
from noticework.session import settled

BLOCK_DOCS = 500
MAX_BLOCKS = 4096
# Halvings that one pass over the sources settles, and passes.
HALVINGS, PASSES = 4, 8


def _evaluate(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, largest repetition over the smallest) of each exponent's weights, from one aggregation."""
    share = F.col("tokens") / F.col("all_tokens")
    parts = []
    for i, a in enumerate(exponents):
        raised = F.pow(share, F.lit(a))
        repeats = F.pow(share, F.lit(a - 1.0))
        parts += [F.sum(raised).alias(f"z{i}"), F.sum(raised * F.log(raised)).alias(f"l{i}"), (F.max(repeats) / F.min(repeats)).alias(f"r{i}")]
    row = sources.filter("tokens > 0").agg(*parts).first()
    return [(math.log(row[f"z{i}"]) - row[f"l{i}"] / row[f"z{i}"], row[f"r{i}"]) if row[f"z{i}"] else (0.0, 1.0) for i in range(len(exponents))]


def find_exponent(sources: DataFrame, entropy: float | None = None, max_repetition: float | None = None) -> float:
    """Exponent between 0 and 1 by bisection.

    With ``entropy`` (nats): the one whose mix has that entropy.  With ``max_repetition``: the smallest whose most
    repeated source is not repeated more than that many times as often as the least repeated one.  Both fall
    as the exponent rises; targets out of reach give 0 or 1.
    """
    if (entropy is None) == (max_repetition is None):
        raise ValueError("give either entropy or max_repetition")

    def too_flat(values: tuple[float, float]) -> bool:
        return values[0] > entropy if entropy is not None else values[1] > max_repetition

    low, high = 0.0, 1.0
    if not too_flat(_evaluate(sources, [0.0])[0]):
        return 0.0
    for _ in range(PASSES):
        steps = [low + (high - low) * i / 2 ** HALVINGS for i in range(1, 2 ** HALVINGS)]
        flat = [too_flat(x) for x in _evaluate(sources, steps)]
        above = next((s for s, f in zip(steps, flat, strict=True) if not f), high)
        low = max([low, *(s for s, f in zip(steps, flat, strict=True) if f)])
        high = above
    return high


def mix(docs: DataFrame, entropy: float | None = None, max_repetition: float | None = None, budget: int | None = None, seed: int = 1,
        source: str = "source", identity: str = "doc_id", text: str = "text", tokens: Column | None = None, prefix: str = "mix_",
        keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` as the mix takes them, in their columns ``keep`` (default all): one row per document and pass, with four more columns.

    ``<prefix>tokens``, ``<prefix>weight`` (the source's share of the mix), ``<prefix>pass`` (from 0) and ``<prefix>place`` (the block's place
    in that pass).  ``tokens`` counts a document's tokens, default words.  Without ``budget`` (tokens of the whole mix)
    the mix is the smallest that takes every document at least once.  A part of a pass ends before the first
    group of equal documents that would exceed the budget.

    Where ``keep`` leaves the text out, texts are read once: the kept columns are written down next to the counts.

    A null source is a source of its own; documents without tokens come in every whole pass; equal rows are
    taken together; an empty table gives an empty result; columns named like the new ones are replaced.
    """
    names = {n: prefix + n for n in ("tokens", "weight", "pass", "place")}
    replaced = {n.lower() for n in names.values()}
    docs = docs.select(*(c for c in docs.columns if c.lower() not in replaced))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in replaced]
    s, n, b, k = (fresh(docs, x) for x in ("mixed_source", "mixed_tokens", "mixed_block", "mixed_key"))
    counted = docs.withColumns({s: F.coalesce(F.col(source).cast("string"), F.lit("")), n: word_count(F.col(text)) if tokens is None else tokens})
    # One null and one empty source stay apart by this flag inside the key.
    counted = counted.withColumn(s, F.concat(F.when(F.col(source).isNull(), "-").otherwise("+"), F.col(s)))
    keyed = counted.withColumn(k, F.xxhash64(F.lit(seed), F.col(identity), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    counts = [s, n, k]
    if text.lower() in (c.lower() for c in kept):
        numbers = settled(keyed.select(*counts), "mix")
    else:
        numbers = keyed = settled(keyed.select(*kept, *counts), "mix")
    narrow = numbers.select(F.col(s).alias("source"), F.col(n).alias("tokens"), F.col(k).alias("key"))
    sources = settled(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    sources = sources.withColumn("all_tokens", F.lit(max(total, 1)))
    exponent = find_exponent(sources, entropy, max_repetition)
    share = F.col("tokens") / F.col("all_tokens")
    totals = sources.filter("tokens > 0").agg(F.sum(F.pow(share, F.lit(exponent))).alias("z"), F.max(share).alias("top")).first()
    z, top = totals["z"] or 1.0, totals["top"] or 1.0
    whole = float(budget) if budget is not None else total * z * top ** (1.0 - exponent)
    # The budget of a source is cut to whole tokens; a hair is added so that exact multiples stay whole passes.
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / z).otherwise(0.0)
    wanted = F.floor(weight * whole * (1 + 1e-12) + 1e-6)
    passes = (F.when(F.col("tokens") > 0, F.floor(wanted / F.col("tokens"))).otherwise(1)).cast("bigint")
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("bigint")
    budgets = settled(sources.select("source", weight.alias("weight"), passes.alias("passes"), blocks.alias("blocks"),
                                     F.when(F.col("tokens") > 0, wanted - passes * F.col("tokens")).otherwise(0).alias("rest")), "budgets")

    # Block numbers depend on the key and the source's number of blocks.
    blocked = narrow.join(budgets, "source").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    sizes = blocked.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.first("weight").alias("weight"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    turn = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))).alias("pass")
    visits = sizes.select("source", "block", "tokens", "weight", "passes", "rest", turn).withColumn("order", F.xxhash64(F.lit(seed), "source", "pass", "block"))
    along = Window.partitionBy("source", "pass").orderBy("order", "block")
    before = F.coalesce(F.sum("tokens").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = visits.select("*", (F.row_number().over(along) - 1).cast("bigint").alias("place"), before.alias("before"))
    full = F.col("pass") < F.col("passes")
    taken = placed.filter(full | (F.col("before") < F.col("rest"))).select(
        "source", "block", "weight", "pass", "place", (~full & (F.col("before") + F.col("tokens") > F.col("rest"))).alias("partly"), (F.col("rest") - F.col("before")).alias("room"))
    taken = settled(taken, "visits")
    # In the one block per source that the budget cuts, documents come in the order of their keys.
    part = taken.filter("partly").select("source", "block", "room")
    upto = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("key"))
    cuts = (blocked.select("source", "block", "key", "tokens").join(part, ["source", "block"]).withColumn("upto", upto)
            .filter(F.col("upto") <= F.col("room")).groupBy("source", "block").agg(F.max("key").alias("cut")))
    visit = taken.join(cuts, ["source", "block"], "left").filter(~F.col("partly") | F.col("cut").isNotNull()).select(
        F.col("source").alias(s), F.col("block").alias(b), F.struct("weight", "pass", "place", F.when(F.col("partly"), F.col("cut")).alias("cut")).alias("visit"))
    visit = visit.groupBy(s, b).agg(F.collect_list("visit").alias(fresh(docs, "mixed_visits")))
    per_source = budgets.select(F.col("source").alias(s), F.col("blocks").alias(fresh(docs, "mixed_blocks")))
    v, w = fresh(docs, "mixed_visits"), fresh(docs, "mixed_visit")
    met = (keyed.join(per_source, s).withColumn(b, F.pmod(F.xxhash64(k), F.col(fresh(docs, "mixed_blocks"))))
           .join(visit, [s, b]).withColumn(w, F.explode(v)).filter(F.col(f"{w}.cut").isNull() | (F.col(k) <= F.col(f"{w}.cut"))))
    return met.select(*kept, F.col(n).alias(names["tokens"]), *(F.col(f"{w}.{x}").alias(names[x]) for x in ("weight", "pass", "place")))
