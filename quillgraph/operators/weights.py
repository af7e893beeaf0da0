"""Search-path traversal weights of arcs, as sums over walk lengths.

With W_p(u) the walks of p arcs that end at u, S_p(u) those of them from sources, and their counterparts ahead:

    Pb = sum S_p, Nb = sum W_p, Db = sum decay^p W_p, Hb = sum W_p / (p + 1); Pf and Nf likewise from the other side

    SPC = Pb(u) Pf(v), SPLC = Nb(u) Pf(v), SPNP = Nb(u) Nf(v), SPGD = Db(u) Pf(v), SPHD = Hb(u) Pf(v)

    SPAD = sum over p < L of (1 - p decay) W_p(u) F_{L-1-p}(v), L the first length at which the strength is gone, and
    F_r(v) the ways to go on from v for r arcs or until a sink

so that no walk is ever enumerated. Counts are doubles, exact up to 2^53.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.kernel import cut
from .graph import degrees, walks

METHODS = ("SPC", "SPLC", "SPNP", "SPAD", "SPGD", "SPHD")


def forward(edges: DataFrame) -> DataFrame:
    """(node, pf, nf): paths to sinks, and nodes met on all walks ahead, the node itself included."""
    return walks(edges, degrees(edges), reverse=True).groupBy("node").agg(F.sum("s").alias("pf"), F.sum("w").alias("nf"))


def backward(edges: DataFrame, decay: float = 0.5) -> DataFrame:
    """(node, pb, nb, db, hb): paths from sources, nodes met on all walks back, and those with decayed strengths."""
    w = walks(edges, degrees(edges))
    return w.groupBy("node").agg(F.sum("s").alias("pb"), F.sum("w").alias("nb"), F.sum(F.pow(F.lit(float(decay)), F.col("p")) * F.col("w")).alias("db"), F.sum(F.col("w") / (F.col("p") + 1)).alias("hb"))


def _on_arcs(edges: DataFrame, back: DataFrame, ahead: DataFrame, value) -> DataFrame:
    u = back.withColumnRenamed("node", "src")
    v = ahead.withColumnRenamed("node", "dst")
    return edges.join(u, "src").join(v, "dst").select(*edges.columns, value.alias("spx"))


def _reach(edges: DataFrame, steps: int) -> DataFrame:
    """(node, r, f): ways to go on for exactly r arcs, or fewer to a sink, for r up to ``steps``."""
    ahead = walks(edges, degrees(edges), reverse=True)
    # of the walks of p arcs ahead, those to sinks count for every r >= p, the others for r = p alone
    some = ahead.select("node", "p", "w", "s")
    sunk = some.select("node", F.explode(F.sequence(F.col("p"), F.greatest(F.lit(steps), F.col("p")))).alias("r"), F.col("s").alias("f"))
    other = some.select("node", F.col("p").alias("r"), (F.col("w") - F.col("s")).alias("f"))
    return sunk.unionByName(other).where(F.col("r") <= steps).groupBy("node", "r").agg(F.sum("f").alias("f"))


def arithmetic_length(decay: float, depth: int) -> int:
    """The first number of arcs after which the strength 1 - L decay is gone; without decay, all there are."""
    return depth + 1 if decay <= 0 else min(depth + 1, math.ceil(1 / decay - 1e-9))


def arithmetic_decay(edges: DataFrame, decay: float) -> DataFrame:
    """SPAD of every arc."""
    net = cut(degrees(edges))
    back = cut(walks(edges, net))
    depth = back.agg(F.max("p")).first()[0] or 0
    length = arithmetic_length(decay, depth)
    ahead = _reach(edges, length)
    u = back.where(F.col("p") < length).select(F.col("node").alias("src"), "p", "w")
    v = ahead.select(F.col("node").alias("dst"), "r", "f")
    arcs = edges.withColumn("__arc", F.monotonically_increasing_id())
    arcs = cut(arcs)
    each = arcs.select("__arc", "src", "dst").join(u, "src").withColumn("r", F.lit(length - 1) - F.col("p")).join(v, ["dst", "r"])
    sums = each.groupBy("__arc").agg(F.sum((1 - F.col("p") * float(decay)) * F.col("w") * F.col("f")).alias("spx"))
    return arcs.join(sums, "__arc", "left").select(*edges.columns, F.coalesce("spx", F.lit(0.0)).alias("spx"))


def effective_outflow(edges: DataFrame, method: str, decay: float = 0.5) -> DataFrame:
    """(node, eff_out): completed chains that begin at a node, under SPAD (which end with the strength) or SPHD."""
    if method == "SPHD":
        return forward(edges).select("node", F.col("pf").alias("eff_out"))
    depth = walks(edges, degrees(edges)).agg(F.max("p")).first()[0] or 0
    length = arithmetic_length(decay, depth)
    return _reach(edges, length).where(F.col("r") == length).select("node", F.col("f").alias("eff_out"))


def spx(edges: DataFrame, method: str = "SPC", decay: float = 0.5) -> DataFrame:
    """``edges`` with their traversal weight in the column spx."""
    if method not in METHODS:
        raise ValueError(f"{method} is none of {', '.join(METHODS)}")
    if method == "SPAD":
        return arithmetic_decay(edges, decay)
    back, ahead = {"SPC": ("pb", "pf"), "SPLC": ("nb", "pf"), "SPNP": ("nb", "nf"), "SPGD": ("db", "pf"), "SPHD": ("hb", "pf")}[method]
    return _on_arcs(edges, backward(edges, decay).select("node", back), forward(edges).select("node", ahead), F.col(back) * F.col(ahead))


def overflow_check(weighted: DataFrame) -> DataFrame:
    """The arcs whose weight isn't a finite number, which a count beyond doubles would give."""
    return weighted.where(F.isnan("spx") | F.col("spx").isin(float("inf"), float("-inf")))


def total_paths(edges: DataFrame) -> DataFrame:
    """One row, total_paths: paths from sources to sinks."""
    net = degrees(edges)
    return walks(edges, net, reverse=True).join(net.where("kind = 'source'").select("node"), "node", "left_semi").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("total_paths"))


def link_importance(edges: DataFrame, walks_run: float = 10_000_000) -> DataFrame:
    """Expected traversals of each arc by that many random walks: from any node with equal chance, back along
    an incoming arc with equal chance, until a source. Exact, where a simulation would draw."""
    net = cut(degrees(edges))
    n = net.count()
    arcs = cut(edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("m")).join(net.select(F.col("node").alias("dst"), "in_deg"), "dst"))

    from ..plans.kernel import unfold

    def step(now: DataFrame, k: int) -> DataFrame:
        return arcs.join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("chance") * F.col("m") / F.col("in_deg")).alias("chance"))

    seen = unfold(net.select("node", F.lit(1.0 / max(1, n)).alias("chance")), step).groupBy("node").agg(F.sum("chance").alias("chance"))
    at = seen.join(net.select("node", "in_deg"), "node").select(F.col("node").alias("dst"), (float(walks_run) * F.col("chance") / F.col("in_deg")).alias("visits"))
    return edges.join(at, "dst").select(*edges.columns, "visits")


def law_weight(mode: str = "flat", keep_sign: bool = False, base: float = 2.0):
    """The weight of a case-law citation of depth ``weight``: flat, linear or exponential in its size."""
    size = F.abs(F.col("weight"))
    value = {"flat": F.lit(1.0), "linear": size.cast("double"), "exponential": F.pow(F.lit(float(base)), size)}[mode]
    return F.signum("weight") * value if keep_sign else value
