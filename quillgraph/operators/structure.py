"""Structure of a network: components, neighbourhoods, families, cliques, dissimilarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.kernel import cut, fixpoint, unfold
from .graph import nodes_of


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b): both directions of each link once, without self-loops."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): weakly connected components, named by their least node. ``nodes`` adds isolates.

    Alternating star contraction: arcs are hung on the least node that either end knows until all are
    stars; the number of rounds grows with the logarithm of the size and not with the diameter.
    """
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()

    def contract(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return down.unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    stars = fixpoint(pairs, contract, lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()))
    every = nodes_of(edges) if nodes is None else nodes_of(edges).unionByName(nodes.select("node")).distinct()
    return every.join(stars.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("component").agg(F.count("*").alias("size"))


def ego_network(edges: DataFrame, centre, level: int = 2) -> DataFrame:
    """(src, dst, weight): the arcs among the nodes at most ``level`` arcs ahead of, or back from, ``centre``. Arcs of
    weight zero are no links."""
    arcs = cut(edges.where("weight <> 0").select("src", "dst", "weight"))
    start = arcs.sparkSession.createDataFrame([(centre,)], "node " + dict(arcs.dtypes)["src"])

    def reach(a: str, b: str) -> DataFrame:
        return unfold(start, lambda now, k: arcs.join(now.withColumnRenamed("node", a), a, "left_semi").select(F.col(b).alias("node")).distinct().where(F.lit(k <= level)), level + 1)

    near = cut(reach("src", "dst").unionByName(reach("dst", "src")).distinct())
    return arcs.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def assemble_families(documents: DataFrame) -> DataFrame:
    """(family_id, doc_id): documents with a family number other than zero."""
    return documents.where("family_id is not null and cast(family_id as string) not in ('', '0')").select("family_id", "doc_id")


def contract_case_families(edges: DataFrame, families: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``contract_families`` for case law: the representative is a family's last document (by position, then by doc_id), and its
    alias is its own label and the others', last first, joined by ``&``. ``families`` has family_id, doc_id and, where there is
    one, pos; ``documents`` has doc_id and alias."""
    pos = F.col("pos") if "pos" in families.columns else F.lit(0)
    members = families.select("family_id", "doc_id", pos.alias("pos")).join(documents.select("doc_id", "alias"), "doc_id", "left")
    order = F.array_sort(F.collect_list(F.struct("pos", "doc_id", F.coalesce("alias", F.lit("")).alias("alias"))))
    named = members.groupBy("family_id").agg(F.reverse(order).alias("x"))
    named = named.select("family_id", F.get("x", F.lit(0))["doc_id"].alias("representative"), F.array_join(F.transform("x", lambda m: m["alias"]), "&").alias("label"))
    return _contracted(edges, cut(members.join(named, "family_id").select("doc_id", "representative", F.col("label").alias("alias"))))


def contract_families(edges: DataFrame, families: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with each family as its representative, and (doc_id, representative, alias) of all members.

    The representative is the most cited member (ties: the least doc_id). Arcs within a family go, arcs that fall
    together become one, their weights summed. ``documents`` has doc_id, times_cited and alias.
    """
    members = families.join(documents.select("doc_id", F.coalesce("times_cited", F.lit(0)).alias("tc"), "alias"), "doc_id", "left")
    head = members.groupBy("family_id").agg(F.max_by("doc_id", F.struct(F.coalesce("tc", F.lit(0)), F.col("doc_id"))).alias("top"), F.max("tc").alias("most"), F.count("*").alias("n"))
    first = members.join(head, "family_id").where(F.coalesce("tc", F.lit(0)) == F.coalesce("most", F.lit(0))).groupBy("family_id").agg(F.min_by(F.struct("doc_id", "alias"), "doc_id").alias("r"))
    named = head.join(first, "family_id").select("family_id", F.col("r.doc_id").alias("representative"), F.concat(F.lit("FM"), F.col("family_id").cast("string"), F.lit("_"), F.col("n").cast("string"), F.lit("_"), F.coalesce("r.alias", F.lit(""))).alias("alias"))
    where = cut(members.join(named, "family_id").select("doc_id", "representative", named["alias"]))
    return _contracted(edges, where)


def _contracted(edges: DataFrame, where: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs between representatives, and ``where`` (doc_id, representative, alias)."""
    to = where.select("doc_id", "representative")
    moved = edges.join(to.select(F.col("doc_id").alias("src"), F.col("representative").alias("s")), "src", "left").join(to.select(F.col("doc_id").alias("dst"), F.col("representative").alias("d")), "dst", "left")
    moved = moved.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "weight").where("src <> dst")
    return moved.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), where


def dissimilarity(edges: DataFrame) -> DataFrame:
    """``edges`` with dissim: how far the neighbours of an arc's ends differ (a variant of the d5 measure).

    0.45 sqrt(different in / all in) + 0.45 sqrt(different out / all out + 0.1 if the ends are linked one way only and 0.1
    if one of them alone cites itself); a term without neighbours is 0.
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.collect_set("dst").alias("o"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.collect_set("src").alias("i"))
    around = cut(nodes_of(edges).join(out, "node", "left").join(into, "node", "left").select("node", F.coalesce("o", F.array()).alias("o"), F.coalesce("i", F.array()).alias("i")))
    a = around.select(F.col("node").alias("src"), F.col("o").alias("o1"), F.col("i").alias("i1"))
    b = around.select(F.col("node").alias("dst"), F.col("o").alias("o2"), F.col("i").alias("i2"))

    def differ(x: str, y: str):
        # the two ends themselves are told apart by the cross term
        keep = lambda c: F.filter(c, lambda n: (n != F.col("src")) & (n != F.col("dst")))
        apart = F.size(F.array_except(keep(F.col(x)), F.col(y))) + F.size(F.array_except(keep(F.col(y)), F.col(x)))
        return F.coalesce(F.try_divide(apart.cast("double"), (F.size(x) + F.size(y)).cast("double")), F.lit(0.0))

    cross = (F.array_contains("o1", F.col("dst")) != F.array_contains("o2", F.col("src"))).cast("double")
    cross = cross + (F.array_contains("i1", F.col("src")) != F.array_contains("i2", F.col("dst"))).cast("double")
    value = 0.45 * F.sqrt(differ("i1", "i2")) + 0.45 * F.sqrt(differ("o1", "o2") + 0.1 * cross)
    return edges.join(a, "src").join(b, "dst").select(*edges.columns, value.alias("dissim"))


def _cliques(around: dict[object, set], start: set, seen: set) -> Iterator[frozenset]:
    """Maximal cliques among ``start`` that no node of ``seen`` extends, by Bron and Kerbosch with a pivot, without recursion."""
    stack = [(frozenset(), set(start), set(seen))]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            yield r
            continue
        if not p:
            continue
        pivot = max(p | x, key=lambda v: len(around[v] & p))
        for v in sorted(p - around[pivot], key=repr):
            stack.append((r | {v}, p & around[v], x & around[v]))
            p = p - {v}
            x = x | {v}


def maximal_cliques(edges: DataFrame, least: int = 3) -> DataFrame:
    """(nodes, size): each maximal clique of at least ``least`` (2 or more) nodes once, directions aside.

    Nodes are ordered by degree and then by name, and a clique is found from its first node: among that one's later
    neighbours, of which a node has at most the root of twice the links, however many it has in all; its earlier neighbours
    only tell which cliques aren't maximal. All that a task needs are triangles, formed once, from their first node.
    """
    links = undirected(edges)
    degree = links.groupBy("a").agg(F.count("*").alias("d"))
    both = links.join(degree.withColumnRenamed("d", "da"), "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    up = cut(both.where(F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))).select("a", "b", "db"))
    one = up.select("a", F.col("b").alias("v"), F.col("db").alias("dv"))
    two = up.select("a", F.col("b").alias("w"), F.col("db").alias("dw"))
    wedge = one.join(two, "a").where(F.struct("dv", "v") < F.struct(F.col("dw").alias("dv"), F.col("w").alias("v")))
    triangle = cut(wedge.join(up.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"], "left_semi").select("a", "v", "w"))
    rows = triangle.select(F.col("a").alias("ego"), F.lit(False).alias("earlier"), F.col("v").alias("n"), F.col("w").alias("m"))
    rows = rows.unionByName(triangle.select(F.col("v").alias("ego"), F.lit(True).alias("earlier"), F.col("a").alias("n"), F.col("w").alias("m")))
    kind = dict(up.dtypes)["a"]
    rows = rows.unionByName(up.select(F.col("a").alias("ego"), F.lit(False).alias("earlier"), F.col("b").alias("n"), F.lit(None).cast(kind).alias("m")))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        me = part["ego"].iloc[0]
        around: dict = {}
        later, before = set(), set()
        for earlier, n, m in zip(part["earlier"], part["n"], part["m"], strict=True):
            around.setdefault(n, set())
            (before if earlier else later).add(n)
            if pd.notna(m):
                around.setdefault(m, set()).add(n)
                around[n].add(m)
                later.add(m)
        found = [sorted([me, *c]) for c in _cliques(around, later, before) if c and len(c) + 1 >= least]
        return pd.DataFrame({"nodes": pd.Series(found, dtype=object), "size": pd.Series([len(c) for c in found], dtype="int32")})

    return rows.groupBy("ego").applyInPandas(search, f"nodes array<{kind}>, size int")
