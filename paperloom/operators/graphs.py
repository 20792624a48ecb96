"""Cycles among the edges of proposals: a proposal with one is rejected as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.knowledge import ORDERED


def cyclic_proposals(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], proposal: str = "proposal_id", relations: tuple[str, ...] = ORDERED) -> DataFrame:
    """(proposal) whose ordered edges (proposal, from_node, to_node, relation) form a cycle; self-loops count.

    A round peels edges whose start nothing leads to or whose end leads nowhere. A proposal of which nothing can be peeled has a
    cycle and leaves. Then every edge into a node with one way on is led to where that goes, which halves all such
    chains and keeps every cycle: a chain of n edges takes log2(n) rounds, a net of ways one round a layer at most.
    Only edges of undecided proposals stay in work. cut() stores a round.
    """
    p = proposal
    kept = edges.filter(F.col("relation").isin(*relations)).filter(F.col("from_node").isNotNull() & F.col("to_node").isNotNull())
    left = cut(kept.select(p, F.col("from_node").alias("u"), F.col("to_node").alias("v")).distinct())
    found: list[DataFrame] = []
    while left.take(1):
        fed = left.join(left.select(p, F.col("v").alias("u")).distinct(), [p, "u"], "left_semi")
        core = cut(fed.join(left.select(p, F.col("u").alias("v")).distinct(), [p, "v"], "left_semi").select(p, "u", "v"))
        before, after = left.groupBy(p).agg(F.count("*").alias("_n")), core.groupBy(p).agg(F.count("*").alias("_m"), F.max(F.col("u") == F.col("v")).alias("_loop"))
        # nothing was peeled, or a node leads to itself
        cyclic = cut(before.join(after, p).filter(F.col("_loop") | (F.col("_n") == F.col("_m"))).select(p))
        found.append(cyclic)
        open_ = core.join(cyclic, p, "left_anti")
        one_way = open_.groupBy(p, F.col("u").alias("v")).agg(F.count("*").alias("_n"), F.first("v").alias("_on")).filter("_n = 1").drop("_n")
        left = cut(open_.join(one_way, [p, "v"], "left").select(p, "u", F.coalesce("_on", "v").alias("v")).distinct())
    out = left.select(p)
    for part in found:
        out = out.unionByName(part)
    return out.distinct()


def accepted_edges(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], proposal: str = "proposal_id") -> DataFrame:
    """edges with the reason of rejection: ``cycle`` for every edge of a proposal with a cycle, whatever its own relation."""
    bad = cyclic_proposals(edges, cut, proposal).withColumn("reason", F.lit("cycle"))
    return edges.join(bad, proposal, "left")
