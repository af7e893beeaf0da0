"""How alike the ends of an arc are, reweighting by it, and critical transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import long_form
from ..functions.patents import truncated
from .structure import undirected

STRATEGIES = ("flat", "cpc", "cpc4", "cpc_slash", "citation", "cpc4_citation", "cpc_slash_citation", "keyword", "citation_generalised", "keyword_citation")


def pair_similarity(edges: DataFrame, features: DataFrame, generalised: bool = False) -> DataFrame:
    """(src, dst, similarity): the Jaccard similarity of both ends' features; 0 where neither has any.

    ``features`` has (doc_id, key, cnt). Only arcs are compared: no pairs of documents are formed.
    """
    arcs = edges.select("src", "dst").distinct()
    a = arcs.join(features.select(F.col("doc_id").alias("src"), "key", F.col("cnt").alias("a")), "src").select("src", "dst", "key", "a", F.lit(0).alias("b"))
    b = arcs.join(features.select(F.col("doc_id").alias("dst"), "key", F.col("cnt").alias("b")), "dst").select("src", "dst", "key", F.lit(0).alias("a"), "b")
    long = a.unionByName(b).groupBy("src", "dst", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    near = long.groupBy("src", "dst").agg((1 - long_form("generalised_jaccard" if generalised else "jaccard")).alias("similarity"))
    return arcs.join(near, ["src", "dst"], "left").select("src", "dst", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def neighbour_features(edges: DataFrame) -> DataFrame:
    """(doc_id, key, cnt): each node's neighbours, whatever the direction."""
    return undirected(edges).select(F.col("a").alias("doc_id"), F.col("b").alias("key"), F.lit(1).alias("cnt"))


def code_features(codes: DataFrame, to: int | str | None = None) -> DataFrame:
    """(doc_id, key, cnt) of (doc_id, ipc) rows, codes truncated as asked."""
    key = F.col("ipc") if to is None else truncated(F.col("ipc"), to)
    return codes.select("doc_id", key.alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("cnt"))


def pooled(features: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, key, cnt): the keys of all documents of a group together, counts summed; ``groups`` has (group, doc_id).

    Two documents, or three of a triad, whose neighbours, codes or keywords are to be compared as one vector are a group.
    """
    return groups.join(features, "doc_id").groupBy("group", "key").agg(F.sum("cnt").alias("cnt"))


def keyword_features(doc_terms: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, cnt) of a document's terms, of the report list where there is one."""
    rows = doc_terms.select("doc_id", F.col("term").alias("key"), F.col("n_total").alias("cnt"))
    return rows if report is None else rows.join(report.select(F.lower("term").alias("key")).distinct(), "key", "left_semi")


def edge_relevancy(edges: DataFrame, strategy: str, codes: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """``edges`` with relevancy, by one of STRATEGIES; 1 for ``flat``."""
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy} is none of {', '.join(STRATEGIES)}")
    if strategy == "flat":
        return edges.withColumn("relevancy", F.lit(1.0))
    cut_to = {"cpc": None, "cpc4": 4, "cpc_slash": "/"}.get(strategy.replace("_citation", ""), None)
    parts = []
    if strategy.startswith("cpc"):
        parts.append(pair_similarity(edges, code_features(codes, cut_to)))
    if strategy.startswith("keyword"):
        parts.append(pair_similarity(edges, keywords))
    if "citation" in strategy:
        parts.append(pair_similarity(edges, neighbour_features(edges), generalised=strategy != "citation"))
    out = parts[0].withColumnRenamed("similarity", "s0")
    value = F.col("s0")
    if len(parts) == 2:
        out = out.join(parts[1].withColumnRenamed("similarity", "s1"), ["src", "dst"])
        value = 0.5 * F.col("s0") + 0.5 * F.col("s1")
    return edges.join(out.select("src", "dst", value.alias("relevancy")), ["src", "dst"], "left").select(*edges.columns, F.coalesce("relevancy", F.lit(1.0)).alias("relevancy"))


def reweight(weighted: DataFrame) -> DataFrame:
    """spx times relevancy."""
    return weighted.withColumn("spx", F.col("spx") * F.col("relevancy"))


def cut_off(weighted: DataFrame, share: float | None = None) -> float:
    """The spx at the middle rank, largest first; or at the given share of ranks."""
    n = weighted.count()
    k = n // 2 + 1 if share is None else max(1, int(share * n))
    found = weighted.select("spx").orderBy(F.desc("spx")).limit(k).agg(F.min("spx")).first()[0]
    return float(found or 0.0)


def critical_transitions(weighted: DataFrame, centres: DataFrame, keywords: DataFrame, cut: float = 0.0, kind: str = "overlap") -> DataFrame:
    """(node, n_positive, n_triads, share, mean, min, max, std) of the excess of each centre on a main path.

    For all a -> b -> c over a centre b with both arcs' spx at least ``cut``: D is half the distance of keywords, a quarter of
    that of citing and a quarter of that of cited neighbours; the excess is D(a, c) - D(a, b) - D(b, c). Triads
    are paths over b, of which a hub may have the product of its degrees.
    """
    strong = weighted.where(F.col("spx") >= cut).select("src", "dst").distinct()
    b = centres.select(F.col("node")).distinct()
    triads = strong.withColumnRenamed("src", "a").withColumnRenamed("dst", "node").join(b, "node").join(strong.select(F.col("src").alias("node"), F.col("dst").alias("c")), "node")
    pairs = triads.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("c").alias("dst")), F.struct(F.col("a").alias("src"), F.col("node").alias("dst")), F.struct(F.col("node").alias("src"), F.col("c").alias("dst")))).alias("x")).select("x.*").distinct()
    one = F.lit(1).alias("cnt")
    spaces = (
        (0.5, keywords.select("doc_id", "key", "cnt")),
        (0.25, weighted.select(F.col("dst").alias("doc_id"), F.col("src").alias("key"), one).distinct()),
        (0.25, weighted.select(F.col("src").alias("doc_id"), F.col("dst").alias("key"), one).distinct()),
    )
    total = None
    for k, (share, features) in enumerate(spaces):
        d = _pair_distance(pairs, features, kind).withColumn(f"d{k}", share * F.col("distance")).drop("distance")
        total = d if total is None else total.join(d, ["src", "dst"])
    far = total.select("src", "dst", (F.col("d0") + F.col("d1") + F.col("d2")).alias("d"))
    named = triads
    for name, x, y in (("dac", "a", "c"), ("dab", "a", "node"), ("dbc", "node", "c")):
        named = named.join(far.select(F.col("src").alias(x), F.col("dst").alias(y), F.col("d").alias(name)), [x, y])
    excess = F.col("dac") - (F.col("dab") + F.col("dbc"))
    return named.withColumn("excess", excess).groupBy("node").agg(
        F.count_if(F.col("excess") > 0).alias("n_positive"), F.count("*").alias("n_triads"), (F.count_if(F.col("excess") > 0) / F.count("*")).alias("share"),
        F.avg("excess").alias("mean"), F.min("excess").alias("min"), F.max("excess").alias("max"), F.stddev_pop("excess").alias("std"),
    )


def _pair_distance(pairs: DataFrame, features: DataFrame, kind: str) -> DataFrame:
    a = pairs.join(features.select(F.col("doc_id").alias("src"), "key", F.col("cnt").alias("a")), "src").select("src", "dst", "key", "a", F.lit(0).alias("b"))
    b = pairs.join(features.select(F.col("doc_id").alias("dst"), "key", F.col("cnt").alias("b")), "dst").select("src", "dst", "key", F.lit(0).alias("a"), "b")
    long = a.unionByName(b).groupBy("src", "dst", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    d = long.groupBy("src", "dst").agg(long_form(kind).alias("distance"))
    return pairs.join(d, ["src", "dst"], "left").select("src", "dst", F.coalesce("distance", F.lit(0.0 if kind in ("euclidean", "hamming", "kullback_leibler", "jensen_shannon") else 1.0)).alias("distance"))
