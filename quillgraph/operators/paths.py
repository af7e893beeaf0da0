"""Main paths, distances and the best paths of an acyclic citation graph.

The main-path searches follow the literature (Hummon and Doreian 1989, Batagelj 2003, Liu and Lu 2012); ties are
kept. All work on weighted edges (src, dst, spx) and return arcs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.kernel import cut, unfold
from .graph import degrees

PATH_TYPES = ("local_forward", "local_backward", "local_both", "local_key_route", "global", "global_key_route")


def _best(weighted: DataFrame, key: str, tolerance: float) -> DataFrame:
    """The arcs of each node ``key`` whose weight is within ``tolerance``, as a share, of its best."""
    top = weighted.groupBy(key).agg(F.max("spx").alias("__top"))
    return weighted.join(top, key).where(F.col("spx") >= F.col("__top") * (1 - tolerance)).select("src", "dst", "spx")


def _follow(arcs: DataFrame, start: DataFrame, backward: bool) -> DataFrame:
    """The arcs met when one goes on from the nodes ``start`` over ``arcs``, each node once."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    arcs = cut(arcs)
    met = {"nodes": cut(start.distinct())}

    def step(now: DataFrame, k: int) -> DataFrame:
        new = arcs.join(now.select(F.col("node").alias(a)), a, "left_semi").select(F.col(b).alias("node")).distinct().join(met["nodes"], "node", "left_anti")
        new = cut(new)
        met["nodes"] = met["nodes"].unionByName(new)
        if k % 16 == 0:
            met["nodes"] = cut(met["nodes"])
        return new

    seen = unfold(met["nodes"], step)
    return arcs.join(seen.select(F.col("node").alias(a)).distinct(), a, "left_semi").select("src", "dst", "spx")


def local_path(weighted: DataFrame, backward: bool = False, tolerance: float = 0.0) -> DataFrame:
    """From the sources whose best arc is best of all (ties included), always the best arc on; or back from sinks."""
    key = "dst" if backward else "src"
    best = _best(weighted, key, tolerance)
    ends = degrees(weighted).where(F.col("kind") == ("sink" if backward else "source")).select(F.col("node").alias(key))
    first = cut(best.join(ends, key, "left_semi").groupBy(key).agg(F.max("spx").alias("spx")))
    top = first.agg(F.max("spx").alias("top"))
    start = first.join(F.broadcast(top), F.col("spx") >= F.col("top") * (1 - tolerance)).select(F.col(key).alias("node"))  # one row
    return _follow(best, start, backward).distinct()


def key_arcs(weighted: DataFrame, k: int) -> DataFrame:
    """The k arcs of largest weight, and those that tie with the last."""
    last = weighted.select("spx").orderBy(F.desc("spx")).limit(k).agg(F.min("spx").alias("least"))
    return weighted.join(F.broadcast(last), F.col("spx") >= F.col("least")).select("src", "dst", "spx")  # one row


def local_key_route(weighted: DataFrame, k: int = 10, tolerance: float = 0.0) -> DataFrame:
    """From the k key arcs, the best arcs on to sinks and back to sources."""
    keys = cut(key_arcs(weighted, k))
    on = _follow(_best(weighted, "src", tolerance), keys.select(F.col("dst").alias("node")), False)
    back = _follow(_best(weighted, "dst", tolerance), keys.select(F.col("src").alias("node")), True)
    return keys.unionByName(on).unionByName(back).distinct()


def longest(weighted: DataFrame, reverse: bool = False) -> DataFrame:
    """(node, best): the largest sum of spx over paths from sources to a node; with ``reverse`` from it to sinks."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    net = degrees(weighted)
    start = net.where(F.col("kind") == ("sink" if reverse else "source")).select("node", F.lit(0.0).alias("best"))
    arcs = cut(weighted.select(F.col(a).alias("node"), F.col(b).alias("to"), "spx"))
    every = unfold(start, lambda now, k: arcs.join(now, "node").groupBy(F.col("to").alias("node")).agg(F.max(F.col("best") + F.col("spx")).alias("best")))
    return every.groupBy("node").agg(F.max("best").alias("best"))


def _near(a, b):
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def global_path(weighted: DataFrame) -> DataFrame:
    """The arcs of the source-to-sink paths of largest total weight, all that tie."""
    before, after = longest(weighted), longest(weighted, reverse=True)
    through = cut(weighted.join(before.select(F.col("node").alias("src"), F.col("best").alias("b")), "src").join(after.select(F.col("node").alias("dst"), F.col("best").alias("a")), "dst"))
    total = through.agg(F.max(F.col("b") + F.col("spx") + F.col("a")).alias("total"))
    return through.join(F.broadcast(total), _near(F.col("b") + F.col("spx") + F.col("a"), F.col("total"))).select("src", "dst", "spx").distinct()  # one row


def global_key_route(weighted: DataFrame, k: int = 10) -> DataFrame:
    """For each of the k key arcs, the paths of largest total weight that go through it; their arcs."""
    before, after = cut(longest(weighted)), cut(longest(weighted, reverse=True))
    keys = cut(key_arcs(weighted, k))
    tight_on = weighted.join(after.select(F.col("node").alias("src"), F.col("best").alias("x")), "src").join(after.select(F.col("node").alias("dst"), F.col("best").alias("y")), "dst").where(_near(F.col("x"), F.col("spx") + F.col("y")))
    tight_back = weighted.join(before.select(F.col("node").alias("src"), F.col("best").alias("x")), "src").join(before.select(F.col("node").alias("dst"), F.col("best").alias("y")), "dst").where(_near(F.col("y"), F.col("spx") + F.col("x")))
    on = _follow(tight_on.select("src", "dst", "spx"), keys.select(F.col("dst").alias("node")), False)
    back = _follow(tight_back.select("src", "dst", "spx"), keys.select(F.col("src").alias("node")), True)
    return keys.unionByName(on).unionByName(back).distinct()


def main_path(weighted: DataFrame, kind: str = "global", k: int = 10, tolerance: float = 0.0) -> DataFrame:
    """The arcs (src, dst, spx) of a main path of one of PATH_TYPES."""
    if kind == "local_forward":
        return local_path(weighted, False, tolerance)
    if kind == "local_backward":
        return local_path(weighted, True, tolerance)
    if kind == "local_both":
        return local_path(weighted, False, tolerance).unionByName(local_path(weighted, True, tolerance)).distinct()
    if kind == "local_key_route":
        return local_key_route(weighted, k, tolerance)
    if kind == "global":
        return global_path(weighted)
    if kind == "global_key_route":
        return global_key_route(weighted, k)
    raise ValueError(f"{kind} is none of {', '.join(PATH_TYPES)}")


def distances(edges: DataFrame, starts: DataFrame, cost: str = "weight", largest: bool = False) -> DataFrame:
    """(start, node, cost): the least (or largest) sum of ``cost`` from each of ``starts`` (node) to each node that it
    reaches. Arcs of cost zero are no links. Acyclic graphs only."""
    best = F.max if largest else F.min
    arcs = cut(edges.where(F.col(cost) != 0).groupBy(F.col("src").alias("node"), F.col("dst").alias("to")).agg(best(cost).cast("double").alias("c")))
    start = starts.select(F.col("node").alias("start"), "node", F.lit(0.0).alias("cost")).distinct()
    every = unfold(start, lambda now, k: arcs.join(now, "node").groupBy("start", F.col("to").alias("node")).agg(best(F.col("cost") + F.col("c")).alias("cost")).select("start", "node", "cost"))
    return every.where("start <> node").groupBy("start", "node").agg(best("cost").alias("cost"))


def best_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, k: int = 1, cost: str = "weight", largest: bool = False, mean: bool = False) -> DataFrame:
    """(start, end, total, nodes, n_links, rank): for the k best pairs of a start and an end, and those that tie with the
    last, one best path each; with ``mean`` pairs are ordered by cost per link."""
    best = F.max if largest else F.min
    arcs = cut(edges.where(F.col(cost) != 0).groupBy(F.col("src").alias("node"), F.col("dst").alias("to")).agg(best(cost).cast("double").alias("c")))
    sign = -1.0 if largest else 1.0
    pick = lambda rows: rows.groupBy("start", "node").agg(F.min(F.struct((F.lit(sign) * F.col("total")).alias("order"), "nodes", "total")).alias("x")).select("start", "node", F.col("x.total").alias("total"), F.col("x.nodes").alias("nodes"))
    start = starts.select(F.col("node").alias("start"), "node", F.lit(0.0).alias("total"), F.array("node").alias("nodes")).distinct()
    step = lambda now, i: pick(arcs.join(now, "node").select("start", F.col("to").alias("node"), (F.col("total") + F.col("c")).alias("total"), F.concat("nodes", F.array("to")).alias("nodes")))
    found = pick(unfold(start, step).where("start <> node").join(ends.select("node").distinct(), "node", "left_semi"))
    found = found.withColumn("n_links", F.size("nodes") - 1)
    order = F.lit(sign) * (F.col("total") / F.col("n_links") if mean else F.col("total"))
    # no window over all pairs: the k-th value first, then ranks of the few rows up to it
    least = found.select(order.alias("order")).orderBy("order").limit(k).agg(F.max("order").alias("last"))
    few = found.withColumn("order", order).join(F.broadcast(least), F.col("order") <= F.col("last"))  # one row
    return few.select("start", F.col("node").alias("end"), "total", "nodes", "n_links", F.rank().over(Window.orderBy("order")).alias("rank"))
