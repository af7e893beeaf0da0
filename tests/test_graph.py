"""Graphs, weights and paths: hand-computed goldens, identities, and an enumerator on small random graphs."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph, paths, structure, weights

GOLDEN = [("a", "c"), ("b", "c"), ("c", "d"), ("c", "e"), ("d", "f"), ("e", "f")]


@pytest.fixture(scope="module")
def net(spark):
    return lambda arcs: spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src string, dst string, weight double")


def as_dict(df, value="spx"):
    return {(r.src, r.dst): round(r[value], 6) for r in df.collect()}


def test_nodes_of_the_golden_network(net):
    e = net(GOLDEN)
    kinds = {r.node: r.kind for r in graph.degrees(e).collect()}
    assert kinds == {"a": "source", "b": "source", "c": "intermediate", "d": "intermediate", "e": "intermediate", "f": "sink"}
    ahead = {r.node: (r.pf, r.nf) for r in weights.forward(e).collect()}
    assert ahead == {"a": (2, 6), "b": (2, 6), "c": (2, 5), "d": (1, 2), "e": (1, 2), "f": (1, 1)}
    back = {r.node: (r.pb, r.nb, r.db) for r in weights.backward(e, 0.5).collect()}
    assert back == {"a": (1, 1, 1), "b": (1, 1, 1), "c": (2, 3, 2), "d": (2, 4, 2), "e": (2, 4, 2), "f": (4, 9, 3)}
    assert weights.total_paths(e).first()[0] == 4


@pytest.mark.parametrize(("method", "want"), [("SPC", (2, 2, 2)), ("SPLC", (2, 3, 4)), ("SPNP", (5, 6, 4)), ("SPGD", (2, 2, 2)), ("SPAD", (2.0, 2.0, 1.5)), ("SPHD", (2.0, 2.0, 2.166667))])
def test_arcs_of_the_golden_network(net, method, want):
    first, mid, last = want
    assert as_dict(weights.spx(net(GOLDEN), method, 0.5)) == {("a", "c"): first, ("b", "c"): first, ("c", "d"): mid, ("c", "e"): mid, ("d", "f"): last, ("e", "f"): last}


def random_dag(r, n=9):
    names = "abcdefghijkl"[:n]
    return sorted({(a, b) for a, b in itertools.combinations(names, 2) if r.random() < 0.3})


def enumerated(arcs, strength, until=lambda p: False):
    """Every chain from every node: each link gets its strength once for each completed chain that has it."""
    out = collections.defaultdict(list)
    for a, b in arcs:
        out[a].append(b)
    got = dict.fromkeys(arcs, 0.0)

    def go(chain):
        p = len(chain) - 1
        if p and (not out[chain[-1]] or until(p)):
            for k, link in enumerate(zip(chain, chain[1:], strict=False)):
                got[link] += strength(k)
            return
        for b in out[chain[-1]]:
            go([*chain, b])

    for a in list(out):
        go([a])
    return {k: round(v, 6) for k, v in got.items()}


@pytest.mark.parametrize("seed", range(3))
def test_decays_against_an_enumerator(net, seed):
    arcs = random_dag(random.Random(seed))
    e = net(arcs)
    for decay in (0.3, 0.5):
        assert as_dict(weights.spx(e, "SPAD", decay)) == pytest.approx(enumerated(arcs, lambda p, d=decay: 1 - p * d, lambda p, d=decay: 1 - p * d <= 1e-9), abs=1e-5)
    assert as_dict(weights.spx(e, "SPHD")) == pytest.approx(enumerated(arcs, lambda p: 1 / (p + 1)), abs=1e-5)


def test_identities(net):
    e = net(random_dag(random.Random(9), 10))
    splc = as_dict(weights.spx(e, "SPLC"))
    assert as_dict(weights.spx(e, "SPAD", 0.0)) == splc == as_dict(weights.spx(e, "SPGD", 1.0))
    assert set(as_dict(weights.spx(e, "SPAD", 1.0)).values()) == {1.0}
    w = weights.spx(e, "SPC")
    sources = graph.degrees(e).where("kind = 'source'").select(F.col("node").alias("src"))
    assert w.join(sources, "src", "left_semi").agg(F.sum("spx")).first()[0] == weights.total_paths(e).first()[0]
    chain = net(list(itertools.pairwise("abcdefgh")))
    assert set(as_dict(weights.spx(chain)).values()) == {1.0}


def test_loops_and_cycles(net):
    e = net([("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "t")])
    assert tuple(graph.loop_report(e).first()) == (1, 1, 4)
    assert not graph.is_acyclic(e) and graph.is_acyclic(net(GOLDEN))
    assert sorted(tuple(r.nodes) for r in graph.cycles(e).collect()) == [("a", "b"), ("c",), ("x", "y", "z")]
    assert {r.node: r.level for r in graph.levels(net(GOLDEN)).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 2, "f": 3}


def test_importance_is_a_simulation_in_the_mean(net):
    found = as_dict(weights.link_importance(net([("a", "b"), ("b", "c")]), 3000), "visits")
    assert found == {("a", "b"): 2000, ("b", "c"): 1000}


def test_main_paths(spark):
    w = spark.createDataFrame([("a", "b", 5.0), ("b", "d", 1.0), ("a", "c", 4.0), ("c", "d", 4.0), ("d", "e", 5.0), ("x", "c", 1.0)], "src string, dst string, spx double")
    arcs = lambda kind, **k: sorted((r.src, r.dst) for r in paths.main_path(w, kind, **k).collect())
    assert arcs("local_forward") == [("a", "b"), ("b", "d"), ("d", "e")]
    assert arcs("local_backward") == [("a", "c"), ("c", "d"), ("d", "e")]
    assert arcs("global") == [("a", "c"), ("c", "d"), ("d", "e")]
    assert arcs("local_key_route", k=1) == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")]
    assert arcs("global_key_route", k=1) == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")]
    assert arcs("local_both") == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")]
    with pytest.raises(ValueError, match="none of"):
        paths.main_path(w, "other")


def test_best_paths_keep_ties(spark):
    w = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "d", 2.0), ("d", "c", 1.0), ("e", "c", 2.0)], "src string, dst string, weight double")
    ends = lambda k: graph.degrees(w).where(F.col("kind") == k)
    found = paths.best_paths(w, ends("source"), ends("sink"), 1).collect()
    assert sorted((r.start, r.total, r["rank"], tuple(r.nodes)) for r in found) == [("a", 2.0, 1, ("a", "b", "c")), ("e", 2.0, 1, ("e", "c"))]
    assert {(r.start, r.node): r.cost for r in paths.distances(w, ends("source")).collect()}[("a", "c")] == 2.0


def test_structure(net, spark):
    e = net([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")])
    assert {r.node: r.component for r in structure.components(e, spark.createDataFrame([("q",)], "node string")).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "q": "q"}
    assert sorted(tuple(r.nodes) for r in structure.maximal_cliques(e, 2).collect()) == [("a", "b", "c"), ("c", "d"), ("x", "y")]
    assert sorted((r.src, r.dst) for r in structure.ego_network(e, "b", 1).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    d = as_dict(structure.dissimilarity(net([("a", "c"), ("b", "c"), ("a", "b")])), "dissim")
    assert d[("a", "b")] == round(0.45 * 0 + 0.45 * (0 / 3 + 0.1) ** 0.5, 6)


@pytest.mark.parametrize("seed", range(2))
def test_cliques_against_brute_force(net, seed):
    r = random.Random(seed)
    arcs = [(a, b) for a, b in itertools.combinations("abcdefgh", 2) if r.random() < 0.5]
    linked = {frozenset(x) for x in arcs}
    full = [set(c) for k in range(1, 9) for c in itertools.combinations("abcdefgh", k) if all(frozenset(p) in linked for p in itertools.combinations(c, 2))]
    want = sorted(tuple(sorted(c)) for c in full if len(c) >= 2 and not any(c < o for o in full))
    assert sorted(tuple(x.nodes) for x in structure.maximal_cliques(net(arcs), 2).collect()) == want


def test_families(spark, net):
    docs = spark.createDataFrame([("a", 1, "A"), ("b", 5, "B"), ("c", 5, "C"), ("d", 0, "D")], "doc_id string, times_cited int, alias string")
    fam = structure.assemble_families(spark.createDataFrame([("a", "7"), ("b", "7"), ("c", "7"), ("d", "0"), ("e", None)], "doc_id string, family_id string"))
    edges, members = structure.contract_families(net([("a", "b"), ("a", "d"), ("c", "d"), ("d", "e")]), fam, docs)
    assert {(r.src, r.dst): r.weight for r in edges.collect()} == {("b", "d"): 2.0, ("d", "e"): 1.0}
    assert {(r.doc_id, r.representative, r["alias"]) for r in members.collect()} == {(x, "b", "FM7_3_B") for x in "abc"}
