"""Text, patent, distance, relevancy, statistics and group functions on small tables."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import distances, names, patents, text
from quillgraph.operators import clustering, networks, relevancy, stats, weights


def test_tokens_and_phrases(spark):
    df = spark.createDataFrame([("d", "The Cost-Benefit of R&D: a (new) study, of water. Use?"), ("e", None)], "doc_id string, title string")
    words = df.select("doc_id", text.tokens(F.col("title")).alias("w")).collect()
    assert words[0].w == ["the", "cost-benefit", "of", "r&d", "a", "new", "study", "of", "water", "use"] and words[1].w == []
    two = df.where("doc_id = 'd'").select(text.phrases(text.tokens(F.col("title")), 2, ("the", "of", "a")).alias("p")).first().p
    assert two == ["new study", "water use"]
    three = df.where("doc_id = 'd'").select(text.phrases(text.tokens(F.col("title")), 3, ("the", "of", "a")).alias("p")).first().p
    assert three == ["cost-benefit of r&d", "r&d a new", "study of water"]


def test_terms_are_of_titles_and_aliased(spark):
    df = spark.createDataFrame([("d", "Water supply", "water demand and supplies"), ("e", "Demand s", "water")], "doc_id string, title string, abstract string")
    alias = spark.createDataFrame([("Water Supply", "Supply")], "variant string, canonical string")
    vocab = {r.term: r.cnt for r in text.vocabulary(df, aliases=alias).collect()}
    assert vocab == {"water": 1, "supply": 2, "demand": 1, "demand s": 1}
    found = {(r.doc_id, r.term): (r.n_title, r.n_total) for r in text.doc_terms(df, aliases=alias).collect()}
    assert found == {("d", "water"): (1, 2), ("d", "supply"): (2, 2), ("d", "demand"): (0, 1), ("e", "demand"): (1, 1), ("e", "demand s"): (1, 1), ("e", "water"): (0, 1)}


def test_keyword_years_cut(spark):
    terms = spark.createDataFrame([(i, "often", 1) for i in range(10)] + [(1, "rare", 2), (2, "seldom", 1)], "doc_id int, term string, n_total int")
    years = spark.createDataFrame([(i, 2018 + i % 2) for i in range(2500)], "doc_id int, year int")
    found = text.keyword_years(terms, years).collect()
    assert {r.term for r in found} == {"often", "rare"} and {r.year for r in found} == {2018, 2019, 2020}
    report = spark.createDataFrame([("Seldom",), ("none",)], "term string")
    assert {(r.term, r.docs_total) for r in text.keyword_years(terms, years, report=report).collect()} == {("seldom", 1), ("none", 0)}
    assert text.in_report(terms, report).count() == 1 and text.in_report(terms, None).count() == 0


def test_whole_words(spark):
    cases = {"Art of war": 1, "part of": 0, "the ART, of": 5, "state-of-the art; x": 14, "smart": 0, "x.art": 3}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", text.whole_word(F.col("t"), "art").alias("x")).collect()} == cases
    assert df.select(text.anywhere(F.lit("Smart"), "ART").alias("x")).first().x == 3


def test_countries_and_ids(spark):
    df = spark.createDataFrame([("a", 0, "US"), ("a", 1, "TW"), ("b", 0, "vague"), ("b", 1, "vague"), ("b", 2, "JP"), ("c", 0, "unknown")], "name string, pos int, country string")
    assert {r.name: (r.country, r.n_tied) for r in names.main_country(df).collect()} == {"a": ("TW", 2), "b": ("JP", 1), "c": ("unknown", 1)}
    one = spark.range(1).select(names.synthetic_id(F.lit("chen, js"), F.lit(2001), F.lit(12), F.lit(None)).alias("x"), names.page_number(F.lit("S123")).alias("p"), names.page_number(F.lit("")).alias("q")).first()
    assert (one.x, one.p, one.q) == ("C2001000012000000", 123, None)


def test_patents(spark):
    codes = spark.createDataFrame([("p", "A01B 1/00"), ("p", "A01C 3/02")], "doc_id string, ipc string")
    t = codes.select(*(patents.truncated(F.col("ipc"), k).alias(f"t{i}") for i, k in enumerate((4, 5, 6, "/")))).first()
    assert tuple(t) == ("A01B", "A01B ", "A01B 1", "A01B 1")
    con = spark.createDataFrame([("A01B", "10", 50.0), ("A01B", "20", 30.0), ("A01C", "10", 100.0)], "ipc string, isic string, percent double")
    short = codes.select("doc_id", patents.truncated(F.col("ipc"), 4).alias("ipc"))
    assert [(r.isic, r.percent, r["rank"]) for r in patents.industries(short, con).orderBy("rank").collect()] == [("10", 75.0, 1), ("20", 30.0, 2)]
    who = spark.createDataFrame([("d", True), ("d", True), ("e", True), ("e", False), ("f", True), ("f", True), ("f", False), ("g", False)], "doc_id string, u boolean")
    assert {r.doc_id: r.kind for r in patents.collaboration(who, F.col("u")).collect()} == {"d": "UU", "e": "UI", "f": "UUI", "g": None}


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = df.select(*(distances.distance(k, F.col("a"), F.col("b")).alias(k) for k in distances.DISTANCES if "e" != k)).first().asDict()
    assert got["jaccard"] == pytest.approx(2 / 3) and got["generalised_jaccard"] == pytest.approx(1 - 1 / 4) and got["overlap"] == 0.5
    assert got["cosine"] == pytest.approx(1 - 1 / math.sqrt(10)) and got["euclidean"] == pytest.approx(math.sqrt(5)) and got["hamming"] == 2
    none = df.select(distances.jaccard(F.col("z"), F.col("z")).alias("j"), distances.cosine(F.col("a"), F.col("z")).alias("c"), distances.generalised_jaccard(F.col("z"), F.col("z")).alias("g")).first()
    assert tuple(none) == (1.0, 1.0, 1.0)
    same = df.select(distances.kullback_leibler(F.array(F.lit(1.0)), F.array(F.lit(1.0))).alias("k"), distances.jensen_shannon(F.array(F.lit(1.0)), F.array(F.lit(1.0))).alias("j"), distances.smoothed(F.col("a"), 0.5).alias("s")).first()
    assert (same.k, same.j) == (0.0, 0.0) and same.s == pytest.approx([1.5 / 4.5, 0.5 / 4.5, 2.5 / 4.5])


def test_relevancy_and_transitions(spark):
    w = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 2.0), ("x", "b", 1.0)], "src string, dst string, spx double")
    keys = spark.createDataFrame([("a", "k", 1), ("b", "k", 1), ("b", "l", 1), ("c", "l", 1)], "doc_id string, key string, cnt int")
    found = relevancy.edge_relevancy(w, "keyword", keywords=keys)
    assert {(r.src, r.dst): r.relevancy for r in found.collect()} == {("a", "b"): 0.5, ("b", "c"): 0.5, ("x", "b"): 0.0}
    assert {r.src: r.spx for r in relevancy.reweight(found).collect()} == {"a": 1.5, "b": 1.0, "x": 0.0}
    assert {r.relevancy for r in relevancy.edge_relevancy(w, "flat").collect()} == {1.0}
    assert relevancy.cut_off(w) == 2.0 and relevancy.cut_off(w, 0.34) == 3.0
    t = relevancy.critical_transitions(w, spark.createDataFrame([("b",)], "node string"), keys, 2.0).first()
    far, near = 0.5 * 1 + 0.25 * 1 + 0.25 * 1, 0.5 * 0.5 + 0.25 * 1 + 0.25 * 1
    assert (t.n_triads, t.n_positive) == (1, 0) and t["mean"] == pytest.approx(far - 2 * near)
    with pytest.raises(ValueError, match="none of"):
        relevancy.edge_relevancy(w, "other")


def test_indices(spark):
    docs = spark.createDataFrame([(i, c) for i, c in enumerate([10, 8, 5, 4, 3])], "doc_id int, times_cited int")
    members = spark.createDataFrame([(i, "a") for i in range(5)] + [(0, "b")], "doc_id int, name string")
    r = {x.name: x for x in stats.citation_indices(members, docs).collect()}
    assert (r["a"].h, r["a"].g, r["b"].h, r["b"].g) == (4, 5, 1, 1) and r["a"].hm == pytest.approx(3.5)


def test_groups(spark):
    links = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("d", "e", 2), ("c", "d", 1), ("a", "a", 4)], "a string, b string, weight int")
    groups = spark.createDataFrame([(n, 1 if n in "abc" else 2) for n in "abcde"], "name string, group_id int")
    assert {(r.src, r.dst): r.weight for r in networks.shrink(links, groups).collect()} == {(1, 1): 8, (2, 2): 2, (1, 2): 1}
    d = {r.group_id: (r.n, r.n_links, round(r.density, 3)) for r in stats.group_density(links, groups).collect()}
    assert d == {1: (3, 2, 0.667), 2: (2, 1, 1.0)}
    c = {r.group_id: r.centralisation for r in stats.degree_centralisation(links, groups).collect()}
    assert c == {1: 1.0, 2: 0.0}
    k = {r.name: (r.degree, r.weighted_degree, r.intra) for r in stats.degree_centrality(links).collect()}
    assert k["a"] == (2, 4, 4.0)
    r = {x.group_id: x for x in stats.centralisation_against_random(links, groups, draws=300).collect()}
    assert r[1].observed == 2.0 and r[1].expected > 0 and r[2].expected == 0
    own = clustering.label_propagation(links.where("a <> b"), 3)
    assert {x.name for x in own.collect()} == set("abcde")
    part = networks.partition_subnetwork(spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string"), groups, 1)
    assert [tuple(x) for x in part.collect()] == [("a", "b")]
    assert {x.group_id for x in clustering.attach_partition(spark.createDataFrame([("a",), ("q",)], "name string"), groups).collect()} == {1, 999999}


def test_law_weights(spark):
    df = spark.createDataFrame([(-3,), (2,)], "weight int")
    got = df.select(weights.law_weight("flat").alias("f"), weights.law_weight("linear", True).alias("l"), weights.law_weight("exponential").alias("e")).collect()
    assert [tuple(r) for r in got] == [(1.0, -3.0, 8.0), (1.0, 2.0, 4.0)]


def test_pooling(spark):
    f = spark.createDataFrame([("a", "k", 1), ("b", "k", 2), ("b", "l", 1)], "doc_id string, key string, cnt int")
    g = spark.createDataFrame([("g", "a"), ("g", "b")], "group string, doc_id string")
    assert {(r.key, r.cnt) for r in relevancy.pooled(f, g).collect()} == {("k", 3), ("l", 1)}


def test_report(spark, tmp_path):
    docs = spark.createDataFrame([("a", 2000, 1), ("b", 2001, 1), ("c", 2003, 0)], "doc_id string, year int, times_cited int")
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    sections = stats.network_report(docs, e, weights.spx(e))
    stats.write_report({k: sections[k] for k in ("totals", "spx_by_year")}, str(tmp_path))
    back = spark.read.csv(str(tmp_path / "spx_by_year"), header=True, sep="\t").orderBy("year").collect()
    assert [(r.year, r.n_links) for r in back] == [("2000", "1"), ("2001", "1"), ("2002", "0"), ("2003", "0")]
    assert sections["network"].first().n_links == 2


def test_doc_terms_shuffle_postings_only(spark, monkeypatch):
    """Against loops over the words, over several slices and buckets, with a doc_id that is repeated and without; no row of a phrase is shuffled."""
    from quillgraph.functions import postings

    monkeypatch.setattr(postings, "BUCKET", 64)
    rows = [("a", "Cold water, (hot) water", "The cold water of s cold water; r"), ("b", None, "hot water 's cold"), ("c", "s the ring", None), ("d", "  ", "ring of fire of water"), ("a", "fire", "hot water")]
    for docs in (rows, rows[:4]):
        want = {}
        for key, *texts in docs:
            for title, t in zip((1, 0), texts, strict=True):
                w = [x for x in re.split(text.DELIMITERS, (t or "").lower()) if x]
                for n, i in ((n, i) for n in range(1, 5) for i in range(len(w) - n + 1)):
                    term = " ".join(w[i : i + n])
                    if w[i] not in text.STOPWORDS and w[i + n - 1] not in text.STOPWORDS and term not in text.NOISE:
                        a, b = want.get((key, term), (0, 0))
                        want[key, term] = (a + title, b + 1)
        titles = {term for (_, term), (a, _) in want.items() if a}
        found = text.doc_terms(spark.createDataFrame(docs, "doc_id string, title string, abstract string").repartition(3))
        assert {(r.doc_id, r.term): (r.n_title, r.n_total) for r in found.collect()} == {k: v for k, v in want.items() if k[1] in titles}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(term" not in plan and "hashpartitioning(doc_id" not in plan


def test_industries_sum_the_concordance_first(spark, monkeypatch):
    """Against loops, by arrays in pieces of a few rows and by the plain join: repeated rows, ties, nulls; pairs of document and industry aren't shuffled."""
    con = [("a", "10", 50.0), ("a", "10", 20.0), ("a", "20", 35.0), ("b", "10", 5.0), ("b", None, 35.0), ("b", "30", None), ("c", "20", 35.0), (None, "40", 1.0)] + [("d", str(k), 1.0) for k in range(50, 60)] * 3
    codes = [("p", "a"), ("p", "b"), ("q", "a"), ("q", "a"), ("q", "c"), ("r", "none"), (None, "d"), ("s", "b"), ("s", None), ("t", "d")]
    shares = {}
    for doc, ipc in codes:
        for of, isic, percent in con:
            if ipc is not None and of == ipc:
                shares.setdefault(doc, {}).setdefault(isic, []).append(percent)
    want = set()
    for doc, own in shares.items():
        mean = {k: sum(x) / len(x) if (x := [v for v in vs if v is not None]) else None for k, vs in own.items()}
        order = sorted(mean, key=lambda k: (mean[k] is None, -(mean[k] or 0), k is not None, k or ""))
        want |= {(doc, k, mean[k], i) for i, k in enumerate(order, 1)}
    a, b = spark.createDataFrame(codes, "doc_id string, ipc string"), spark.createDataFrame(con, "ipc string, isic string, percent double")
    found = patents.industries(a, b)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "isic" not in plan.split("hashpartitioning(doc_id")[1]
    for pairs in (patents.PAIRS, 0):
        monkeypatch.setattr(patents, "PAIRS", pairs)
        assert {tuple(r) for r in patents.industries(a, b).collect()} == want
        assert {tuple(r) for r in patents.industries(a, b, 2).collect()} == {x for x in want if x[3] <= 2}
