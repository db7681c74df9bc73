"""Chains of corrections: each notice may correct an earlier one, which may itself correct another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticework.session import settled


def chain_roots(links: DataFrame, node: str, corrects: str) -> DataFrame:
    """Rows (node, root, cyclic): the notice that each one goes back to in the end.

    ``links`` has one row per notice, with what it corrects or null; a notice that corrects an unknown one is a root.  Pointers double
    with every round, so a chain of n notices takes about log2(n) rounds, and only notices that have not arrived are
    joined again.  Corrections without a number are left out; of several things that one notice corrects the smallest counts.  Pointers that are still on their way when twice the number of notices is passed go round in a circle: the
    smallest notice of the circle is their root.  Each round is a written table, so a lost executor costs one round.
    """
    known = links.select(F.col(node).alias("node")).filter(F.col("node").isNotNull()).distinct()
    pointed = links.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(corrects).alias("at"))
    held = pointed.join(known.select(F.col("node").alias("at")), "at", "left_semi")
    # ``least`` is the smallest notice among those passed, the present one not included.
    active = settled(held.select("node", "at", F.col("node").alias("least")), "chain")
    done = settled(known.join(active.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(False).alias("cyclic")), "chain")
    passed, limit = 1, 2 * active.count()
    while passed <= limit and not active.isEmpty():
        # A pointer may have come to any notice that has arrived, or to one that is on its way.
        roots = done.select(F.col("node").alias("at"), "root")
        further = active.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("least").alias("next_least"))
        stepped = settled(active.join(roots, "at", "left").join(further, "at", "left"), "chain")
        done = done.unionByName(stepped.filter(F.col("root").isNotNull()).select("node", "root", F.lit(False).alias("cyclic")))
        active = stepped.filter(F.col("root").isNull()).select("node", F.col("next").alias("at"), F.least("least", "next_least").alias("least"))
        passed *= 2
    circle = active.select(F.col("node").alias("at"), F.col("least").alias("root"))
    return done.unionByName(active.select("node", "at").join(circle, "at").select("node", "root", F.lit(True).alias("cyclic")))


def latest_versions(notices: DataFrame, node: str, corrects: str, order: list[str]) -> DataFrame:
    """``notices`` with ``first_version``, ``latest_version``, ``versions`` and ``cyclic`` of the chain or tree of corrections each belongs to.

    The latest is the last by ``order``, then by number.  Rows without a number belong to no chain and drop out.
    """
    roots = settled(chain_roots(notices, node, corrects).select(F.col("node").alias(node), F.col("root").alias("first_version"), "cyclic"), "roots")
    placed = notices.join(roots, node)
    chains = placed.groupBy("first_version").agg(
        F.max(F.struct(*order, node))[node].alias("latest_version"), F.count(F.lit(1)).alias("versions"))
    return placed.join(chains, "first_version")
