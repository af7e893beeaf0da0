"""Citation graphs as DataFrames: edges (src, dst, weight), an arc from the cited to the citing document.

Edges are stored once. Parallel arcs are kept unless ``dedupe`` is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.kernel import cut, unfold


def create_network(edges: DataFrame, dedupe: bool = False) -> DataFrame:
    """Edges with a weight (1 where there is none); with ``dedupe`` parallel arcs become one, their weights summed."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    out = edges.where("src is not null and dst is not null").select("src", "dst", weight.alias("weight"))
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight")) if dedupe else out


def nodes_of(edges: DataFrame) -> DataFrame:
    """(node): every end of an arc once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, in_deg, out_deg, kind): source, sink, intermediate or isolate. ``nodes`` adds nodes without arcs."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    if nodes is not None:
        ends = ends.unionByName(nodes.select("node", F.lit(0).alias("i"), F.lit(0).alias("o")))
    out = ends.groupBy("node").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))
    kind = F.when((F.col("in_deg") == 0) & (F.col("out_deg") == 0), "isolate").when(F.col("in_deg") == 0, "source").when(F.col("out_deg") == 0, "sink").otherwise("intermediate")
    return out.withColumn("kind", kind)


def loop_report(edges: DataFrame) -> DataFrame:
    """One row: duplicate_links (copies beyond the first), self_loops, and loops, where a self-loop counts 1 and a
    pair of opposite arcs 2, parallel arcs each."""
    folded = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    back = folded.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("n").alias("m"))
    both = folded.join(back, ["src", "dst"], "left")
    return both.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_links"),
        F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("self_loops"),
        F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).when(F.col("m").isNotNull(), F.col("n"))), F.lit(0)).alias("loops"),
    )


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The arcs on or between cycles: what is left when sources, and then sinks, are peeled off again and again."""

    def peel(left: DataFrame, key: str, other: str) -> DataFrame:
        n = left.count()
        while n:
            kept = cut(left.join(left.select(F.col(other).alias(key)).distinct(), key, "left_semi").select("src", "dst"))
            m = kept.count()
            left = kept
            if m == n:
                break
            n = m
        return left

    return peel(peel(cut(edges.select("src", "dst").distinct()), "src", "dst"), "dst", "src")


def is_acyclic(edges: DataFrame) -> bool:
    return cyclic_core(edges).isEmpty()


def cycles(edges: DataFrame, max_length: int = 1000) -> DataFrame:
    """(nodes, length): each simple cycle of at most ``max_length`` arcs once, from its least node.

    Only the core is searched, from each node over larger ones; that the number of cycles can be exponential
    lies in the question.
    """
    core = cut(cyclic_core(edges))
    start = core.where("src <= dst").select(F.col("src").alias("first"), F.col("dst").alias("at"), F.array("src").alias("nodes"))
    step = core.select(F.col("src").alias("at"), F.col("dst").alias("to"))

    def longer(paths: DataFrame, k: int) -> DataFrame:
        if k >= max_length:
            return paths.limit(0)
        going = paths.where("at <> first")
        return going.join(step, "at").where("to >= first and not array_contains(nodes, to) and (to = first or to <> at) or to = first").select("first", F.col("to").alias("at"), F.concat("nodes", F.array("at")).alias("nodes"))

    found = unfold(start, longer)
    return found.where("at = first").select("nodes", F.size("nodes").alias("length"))


def walks(edges: DataFrame, nodes: DataFrame, reverse: bool = False) -> DataFrame:
    """(node, p, w, s): walks of exactly p arcs that end at a node (with ``reverse``: that begin there): w from any
    node, s from sources (to sinks) only. Parallel arcs are different walks. The graph must have no cycle.

    ``nodes`` has (node, kind). Everything that traversal weights need is a sum over p of these rows; a step joins the
    arcs with the nodes that still have longer walks, whose number shrinks with p.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    ends = ("sink", "isolate") if reverse else ("source", "isolate")
    start = nodes.select("node", F.lit(0).alias("p"), F.lit(1.0).alias("w"), F.col("kind").isin(*ends).cast("double").alias("s"))
    arcs = cut(edges.groupBy(F.col(a).alias("node"), F.col(b).alias("to")).agg(F.count("*").cast("double").alias("m")))

    def step(now: DataFrame, k: int) -> DataFrame:
        return arcs.join(now, "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("m") * F.col("w")).alias("w"), F.sum(F.col("m") * F.col("s")).alias("s")).select("node", F.lit(k).alias("p"), "w", "s")

    return unfold(start, step)


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the number of arcs of the longest walk that ends at each node, a topological order."""
    return walks(edges, degrees(edges)).groupBy("node").agg(F.max("p").alias("level"))


def node_totals(weighted: DataFrame, column: str = "spx") -> DataFrame:
    """(node, total_in, total_out, node_spx): sums over a node's arcs and half of both together."""
    ends = weighted.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0.0).alias("i"), F.col(column).alias("o")), F.struct(F.col("dst").alias("node"), F.col(column).alias("i"), F.lit(0.0).alias("o")))).alias("x")).select("x.*")
    out = ends.groupBy("node").agg(F.sum("i").alias("total_in"), F.sum("o").alias("total_out"))
    return out.withColumn("node_spx", (F.col("total_in") + F.col("total_out")) / 2)
