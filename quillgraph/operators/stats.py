"""Statistics of a corpus and its networks; each report section is a DataFrame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def corpus_totals(docs: DataFrame) -> DataFrame:
    """One row: n_docs, n_cited, total_citations, mean_citations of (doc_id, times_cited)."""
    tc = F.coalesce("times_cited", F.lit(0))
    return docs.agg(F.count("*").alias("n_docs"), F.count_if(tc != 0).alias("n_cited"), F.coalesce(F.sum(tc), F.lit(0)).alias("total_citations"), F.avg(tc).alias("mean_citations"))


def growth(docs: DataFrame, year: str = "year") -> DataFrame:
    """(year, n, cumulative); ``year`` may be the application year. The window is over a row for each year."""
    n = docs.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("year")).agg(F.count("*").alias("n"))
    return n.withColumn("cumulative", F.sum("n").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def network_summary(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row of counts by kind of node, arcs, arcs for each node, and density."""
    n = kinds.agg(F.count("*").alias("n_nodes"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("source", "sink", "intermediate", "isolate")))
    m = edges.agg(F.count("*").alias("n_links"))
    both = n.withColumn("__one", F.lit(1)).join(F.broadcast(m.withColumn("__one", F.lit(1))), "__one").drop("__one")  # one row each
    nodes = F.col("n_nodes").cast("double")
    return both.withColumn("links_per_node", F.try_divide("n_links", nodes)).withColumn("density", F.coalesce(F.try_divide(F.col("n_links"), nodes * (nodes - 1)), F.lit(0.0)))


def component_histogram(sizes: DataFrame) -> DataFrame:
    """(bucket, n): components of 1 to 10 nodes, and of more as 11."""
    return sizes.groupBy(F.least("size", F.lit(11)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def largest_components(sizes: DataFrame, top: int = 10) -> DataFrame:
    return sizes.orderBy(F.desc("size"), "component").limit(top)


def top_links(weighted: DataFrame, top: int = 5000, inflow: DataFrame | None = None, outflow: DataFrame | None = None) -> DataFrame:
    """The ``top`` arcs by spx, with relevancy where there is such a column, and inflow and outflow where they are given.

    ``inflow`` and ``outflow`` have (node, flow): what comes to an arc's source and goes on from its target, by the weight's
    kind, for instance pb and pf for SPC. They meet the chosen arcs only.
    """
    out = weighted.orderBy(F.desc("spx"), "src", "dst").limit(top)
    for name, flows, end in (("inflow", inflow, "src"), ("outflow", outflow, "dst")):
        if flows is not None:
            out = out.join(flows.select(F.col("node").alias(end), F.col("flow").alias(name)), end, "left")
    return out.select(*weighted.columns, *(n for n, f in (("inflow", inflow), ("outflow", outflow)) if f is not None))


def places_of(members: DataFrame, key: str = "doc_id", areas: DataFrame | None = None) -> DataFrame:
    """(key, country, countries, area) of (key, pos, country) rows: the most frequent country (ties: the last listed), all of
    them by name, and the area of the first by ``areas`` (country, area)."""
    from ..functions.names import main_country

    rows = members.select(F.col(key).alias("name"), "pos", "country")
    out = main_country(rows).select("name", "country").join(rows.groupBy("name").agg(F.array_sort(F.collect_set("country")).alias("countries")), "name")
    if areas is not None:
        out = out.join(areas.select("country", "area"), "country", "left")
    else:
        out = out.withColumn("area", F.lit(None).cast("string"))
    return out.select(F.col("name").alias(key), "country", "countries", "area")


def article_table(docs: DataFrame, kinds: DataFrame, totals: DataFrame, places: DataFrame | None = None, areas: DataFrame | None = None) -> DataFrame:
    """Documents with degrees and traversal weights; those outside the network have zeros. With ``places`` (doc_id, pos,
    country) country, countries and area too."""
    out = docs.join(kinds.select(F.col("node").alias("doc_id"), "in_deg", "out_deg"), "doc_id", "left").join(totals.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.na.fill(0, ["in_deg", "out_deg"]).na.fill(0.0, ["total_in", "total_out", "node_spx"])
    return out if places is None else out.join(places_of(places, "doc_id", areas), "doc_id", "left")


def indicator_matrix(docs: DataFrame, members: DataFrame, report: list[str], column: str = "term") -> DataFrame:
    """A row for each document and a 0/1 column for each report entry, which are few by their nature."""
    has = members.where(F.col(column).isin(*report)).groupBy("doc_id").agg(F.collect_set(column).alias("__has"))
    rows = docs.select("doc_id").join(has, "doc_id", "left")
    return rows.select("doc_id", *(F.coalesce(F.array_contains("__has", t), F.lit(False)).cast("int").alias(t) for t in report))


def citation_indices(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(name, h, g, hm) of (doc_id, name) and (doc_id, times_cited): Hirsch's h, Egghe's g, Schreiber's hm.

    Ranks are within a name's documents, most cited first, ties by doc_id.
    """
    n_authors = members.groupBy("doc_id").agg(F.countDistinct("name").alias("n_authors"))
    rows = members.select("doc_id", "name").distinct().join(docs.select("doc_id", F.coalesce("times_cited", F.lit(0)).alias("tc")), "doc_id").join(n_authors, "doc_id")
    order = Window.partitionBy("name").orderBy(F.desc("tc"), "doc_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.select("name", "tc", F.row_number().over(order).alias("r"), F.sum("tc").over(upto).alias("c"), F.sum(1.0 / F.col("n_authors")).over(upto).alias("e"))
    return ranked.groupBy("name").agg(
        F.coalesce(F.max(F.when(F.col("tc") >= F.col("r"), F.col("r"))), F.lit(0)).alias("h"),
        F.coalesce(F.max(F.when(F.col("c") >= F.col("r") * F.col("r"), F.col("r"))), F.lit(0)).alias("g"),
        F.coalesce(F.max(F.when(F.col("tc") >= F.col("e") - 1e-12, F.col("e"))), F.lit(0.0)).alias("hm"),
    )


def author_table(doc_authors: DataFrame, docs: DataFrame, totals: DataFrame | None = None, places: DataFrame | None = None, areas: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """First authors: h, g, hm, n_papers, n_first, n_single, n_inter, first_year, last_year, total_cites, total_in, total_out;
    with ``places`` (name, pos, country) country, countries and area, with ``groups`` group_id.

    ``docs`` has doc_id, year, times_cited, n_authors, n_countries.
    """
    from .networks import first_names

    first = first_names(doc_authors)
    facts = docs.select("doc_id", "year", F.coalesce("times_cited", F.lit(0)).alias("tc"), "n_authors", "n_countries")
    if totals is not None:
        facts = facts.join(totals.select(F.col("node").alias("doc_id"), "total_in", "total_out"), "doc_id", "left")
    else:
        facts = facts.withColumn("total_in", F.lit(0.0)).withColumn("total_out", F.lit(0.0))
    rows = doc_authors.select("doc_id", "name").distinct().join(first.select("name").distinct(), "name", "left_semi").join(facts, "doc_id")
    rows = rows.join(first.withColumn("is_first", F.lit(1)), ["doc_id", "name"], "left")
    mine = F.col("is_first").isNotNull()
    table = rows.groupBy("name").agg(
        F.count("*").alias("n_papers"), F.count("is_first").alias("n_first"), F.count_if(mine & (F.col("n_authors") == 1)).alias("n_single"), F.count_if(F.col("n_countries") > 1).alias("n_inter"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("tc").alias("total_cites"), F.coalesce(F.sum("total_in"), F.lit(0.0)).alias("total_in"), F.coalesce(F.sum("total_out"), F.lit(0.0)).alias("total_out"),
    )
    table = citation_indices(doc_authors, docs).join(table, "name")
    if places is not None:
        table = table.join(places_of(places, "name", areas), "name", "left")
    if groups is not None:
        table = table.join(groups.select("name", "group_id"), "name", "left")
    return table


def collaboration_counts(docs: DataFrame) -> DataFrame:
    """One row: documents of a single author, and of more than one country."""
    return docs.agg(F.count_if(F.col("n_authors") == 1).alias("n_single"), F.count_if(F.col("n_countries") > 1).alias("n_international"))


def assignee_table(doc_assignees: DataFrame, docs: DataFrame, home: str = "US") -> DataFrame:
    """(name, is_university, n_papers, n_uu, n_uui, n_ui, first_year, last_year, n_collaborators, n_uni, n_industry, n_countries,
    n_areas, mean_cites, max_cites, max_doc, min_cites, min_doc, country, area).

    ``doc_assignees`` has doc_id, pos, name, country, is_university and, where there is one, area; collaborators share a
    document. n_areas counts areas of collaborators in ``home``; country and area are VAGUE where the most frequent is tied.
    """
    from ..functions.patents import collaboration

    area = F.col("area") if "area" in doc_assignees.columns else F.lit(None).cast("string")
    who = doc_assignees.select("doc_id", "pos", "name", "country", "is_university", area.alias("area"))
    a = who.select("doc_id", "name").distinct()
    b = who.select("doc_id", F.col("name").alias("other"), "country", "is_university", "area").distinct()
    at_home = F.col("country") == home
    near = a.join(b, "doc_id").where("name <> other").groupBy("name").agg(
        F.countDistinct("other").alias("n_collaborators"), F.countDistinct(F.when(F.col("is_university"), F.col("other"))).alias("n_uni"), F.countDistinct(F.when(~F.col("is_university"), F.col("other"))).alias("n_industry"),
        F.countDistinct("country").alias("n_countries"), F.countDistinct(F.when(at_home, F.col("area"))).alias("n_areas"),
    )
    kinds = collaboration(who.select("doc_id", "name", "is_university").distinct(), F.col("is_university"))
    facts = docs.select("doc_id", "year", F.coalesce("times_cited", F.lit(0)).alias("tc")).join(kinds, "doc_id", "left")
    cites = a.join(facts, "doc_id").groupBy("name").agg(
        F.count("*").alias("n_papers"), *(F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in ("UU", "UUI", "UI")), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.avg("tc").alias("mean_cites"),
        F.max(F.struct("tc", (-F.col("doc_id")).alias("d"))).alias("hi"), F.min(F.struct("tc", "doc_id")).alias("lo"),
    )
    place = _clear(who.select("name", "pos", "country"), "country").join(_clear(who.where("area is not null").select("name", "pos", F.col("area").alias("country")), "area"), "name", "left")
    kind = who.groupBy("name").agg(F.max("is_university").alias("is_university"))
    counts = ["n_collaborators", "n_uni", "n_industry", "n_countries", "n_areas"]
    out = cites.join(near, "name", "left").na.fill(0, counts).join(kind, "name").join(place, "name", "left").withColumn("area", F.coalesce("area", F.lit("~")))
    return out.select(
        "name", "is_university", "n_papers", "n_uu", "n_uui", "n_ui", "first_year", "last_year", *counts, "mean_cites", F.col("hi.tc").alias("max_cites"), (-F.col("hi.d")).alias("max_doc"), F.col("lo.tc").alias("min_cites"), F.col("lo.doc_id").alias("min_doc"), "country", "area"
    )


def _clear(rows: DataFrame, to: str) -> DataFrame:
    """(name, ``to``): the most frequent ``country`` of (name, pos, country) rows, or VAGUE if several are."""
    from ..functions.names import main_country

    return main_country(rows).select("name", F.when(F.col("n_tied") > 1, "VAGUE").otherwise(F.col("country")).alias(to))


def patent_table(docs: DataFrame, kinds: DataFrame, totals: DataFrame, doc_assignees: DataFrame, first: int = 5, industries: DataFrame | None = None) -> DataFrame:
    """(doc_id, in_deg, out_deg, total_in, total_out, node_spx, n_assignees, collaboration, assignees, n_countries, country,
    n_areas, area) and, with ``industries`` (doc_id, isic, percent, rank), the ``first`` of these as industries.

    assignees are the first ``first`` of them, collaboration is UU, UI, UUI or null; country and area are the most
    frequent ones, VAGUE if several are, and ``~`` where there is no area.
    """
    from ..functions.patents import collaboration

    area = F.col("area") if "area" in doc_assignees.columns else F.lit(None).cast("string")
    rows = doc_assignees.select("doc_id", "pos", "name", "country", "is_university", area.alias("area"))
    who = rows.groupBy("doc_id").agg(F.countDistinct("name").alias("n_assignees"), F.slice(F.array_sort(F.collect_list(F.struct("pos", "name"))), 1, first).getField("name").alias("assignees"), F.countDistinct("country").alias("n_countries"), F.countDistinct("area").alias("n_areas"))
    named = rows.select(F.col("doc_id").alias("name"), "pos", "country", "area")
    place = _clear(named.select("name", "pos", "country"), "country").join(_clear(named.where("area is not null").select("name", "pos", F.col("area").alias("country")), "area"), "name", "left").withColumnRenamed("name", "doc_id")
    kind = collaboration(rows.select("doc_id", "name", "is_university").distinct(), F.col("is_university")).withColumnRenamed("kind", "collaboration")
    out = article_table(docs.select("doc_id"), kinds, totals).join(who, "doc_id", "left").join(kind, "doc_id", "left").join(place, "doc_id", "left")
    out = out.na.fill(0, ["n_assignees", "n_countries", "n_areas"]).withColumn("area", F.coalesce("area", F.lit("~")))
    if industries is not None:
        top = industries.where(F.col("rank") <= first).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "isic", "percent"))).alias("industries"))
        out = out.join(top.select("doc_id", F.transform("industries", lambda x: F.struct(x["isic"].alias("isic"), x["percent"].alias("percent"))).alias("industries")), "doc_id", "left")
    return out


def spx_by_year(weighted: DataFrame, years: DataFrame) -> DataFrame:
    """(year, n_links, mean_spx, ln_mean) by the year of an arc's source; years between the first and last without
    arcs have zeros."""
    by = weighted.join(years.select(F.col("doc_id").alias("src"), "year"), "src").groupBy("year").agg(F.count("*").alias("n_links"), F.avg("spx").alias("mean_spx"))
    spine = years.where("year is not null").agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    out = spine.join(by, "year", "left").na.fill(0, ["n_links"]).na.fill(0.0, ["mean_spx"])
    return out.withColumn("ln_mean", F.when(F.col("mean_spx") > 0, F.log("mean_spx")).otherwise(0.0))


def spx_histogram(weighted: DataFrame, slots: int = 25) -> DataFrame:
    """(slot, n): arcs by log10 of spx, in equal slots from 0 to that of the largest; those of 1 or less are in slot 1."""
    top = weighted.agg(F.log10(F.max("spx")).alias("top"))
    rows = weighted.where("spx > 0").join(F.broadcast(top))  # one row
    slot = F.when(F.col("top") <= 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(slots), (F.floor(F.log10("spx") / F.col("top") * slots) + 1).cast("int"))))
    return rows.groupBy(slot.cast("int").alias("slot")).agg(F.count("*").alias("n"))


def top_nodes(totals: DataFrame, top: int = 200) -> DataFrame:
    return totals.orderBy(F.desc("total_out"), "node").limit(top)


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """(year, n, n_kinds, entropy, concentration) of (year, key, n) counts."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("year"))  # a row for each kind in a year
    return rows.withColumn("p", p).groupBy("year").agg(F.sum("n").alias("n"), F.count(key).alias("n_kinds"), F.sum(-F.col("p") * F.log("p")).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("concentration"))


def spx_entropy(totals: DataFrame, years: DataFrame) -> DataFrame:
    """By year, the entropy and concentration of the order of magnitude of nodes' outgoing spx (0 for none)."""
    size = F.when(F.col("total_out") > 0, F.log10("total_out").cast("int")).otherwise(0)
    rows = totals.join(years.select(F.col("doc_id").alias("node"), "year"), "node").groupBy("year", size.alias("size")).agg(F.count("*").alias("n"))
    return _spread(rows, "size")


def code_entropy(codes: DataFrame, years: DataFrame) -> DataFrame:
    """By year, the number, distinct number, entropy and concentration of classification codes."""
    return _spread(codes.join(years.select("doc_id", "year"), "doc_id").groupBy("year", "ipc").agg(F.count("*").alias("n")), "ipc")


def array_statistics(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """mean, min, max and the population's standard deviation."""
    c = F.col(column)
    return rows.groupBy(*by).agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_pop(c).alias("std"))


def group_links(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, a, b, weight): the links within groups, self-links too."""
    g = groups.select("name", "group_id")
    return links.join(g.withColumnRenamed("name", "a"), "a").join(g.select(F.col("name").alias("b"), F.col("group_id").alias("__g")), "b").where("group_id = __g").select("group_id", "a", "b", "weight")


def group_density(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, n, n_links, density): 2 L / (n (n - 1)), self-links aside."""
    inside = group_links(links, groups).where("a <> b").groupBy("group_id").agg(F.count("*").alias("n_links"))
    n = groups.groupBy("group_id").agg(F.count("*").alias("n")).join(inside, "group_id", "left").na.fill(0, ["n_links"])
    return n.withColumn("density", F.coalesce(F.try_divide(2.0 * F.col("n_links"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)))


def degree_centrality(links: DataFrame) -> DataFrame:
    """(name, degree, weighted_degree, intra): self-links count in neither degree; their weight is intra."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("name"), F.col("b").alias("o"), "weight"), F.struct(F.col("b").alias("name"), F.col("a").alias("o"), "weight"))).alias("x")).select("x.*")
    other = F.col("name") != F.col("o")
    return ends.groupBy("name").agg(F.count_if(other).alias("degree"), F.coalesce(F.sum(F.when(other, F.col("weight"))), F.lit(0)).alias("weighted_degree"), (F.coalesce(F.sum(F.when(~other, F.col("weight"))), F.lit(0)) / 2).alias("intra"))


def degree_centralisation(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, n, centralisation): the sum of differences to the largest degree, as a share of a star's."""
    d = degree_centrality(group_links(links, groups)).select("name", "degree")
    rows = groups.join(d, "name", "left").na.fill(0, ["degree"])
    top = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.max("degree").alias("top"), F.sum("degree").alias("all"))
    return top.select("group_id", "n", F.coalesce(F.try_divide((F.col("n") * F.col("top") - F.col("all")).cast("double"), (F.col("n") - 1) * (F.col("n") - 2)), F.lit(0.0)).alias("centralisation"))


def centralisation_against_random(links: DataFrame, groups: DataFrame, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """(group_id, n, observed, expected, ratio): the unweighted sum of differences to the largest degree, against the mean
    of the weighted one over ``draws`` random multigraphs with the group's nodes and total weight.

    Draws are from a seed and the group's own figures. A task holds degrees of one group's nodes and 256 draws.
    """
    d = degree_centrality(group_links(links, groups)).select("name", "degree", "weighted_degree")
    rows = groups.join(d, "name", "left").na.fill(0, ["degree", "weighted_degree"])
    facts = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.max("degree").alias("top"), F.sum("degree").alias("all"), F.sum("weighted_degree").alias("strength"))
    kind = dict(groups.dtypes)["group_id"]

    def simulate(batches):
        for pdf in batches:
            expected = []
            for n, strength in zip(pdf["n"], pdf["strength"], strict=True):
                m, n = int(strength) // 2, int(n)
                if n < 3 or m == 0:
                    expected.append(0.0)
                    continue
                r, total = np.random.default_rng([seed, n, m]), 0.0
                pairs = n * (n - 1) // 2
                if pairs <= min(m, 1_000_000):  # how often each pair is drawn is multinomial
                    ends = np.triu_indices(n, 1)
                    step = max(1, min(256, 4_000_000 // pairs))
                else:
                    step = 256
                for at in range(0, draws, step):
                    k = min(step, draws - at)
                    degree = np.zeros((k, n), dtype=np.int64)
                    if pairs <= min(m, 1_000_000):
                        drawn = r.multinomial(m, np.full(pairs, 1 / pairs), size=k)
                        for i in range(k):
                            degree[i] = np.bincount(ends[0], drawn[i], n) + np.bincount(ends[1], drawn[i], n)
                    else:
                        for part in range(0, m, 4096):
                            w = min(4096, m - part)
                            a = r.integers(0, n, size=(k, w))
                            b = (a + r.integers(1, n, size=(k, w))) % n
                            for i in range(k):
                                degree[i] += np.bincount(a[i], minlength=n) + np.bincount(b[i], minlength=n)
                    total += float((degree.max(axis=1) * n - degree.sum(axis=1)).sum())
                expected.append(total / draws)
            out = pd.DataFrame({"group_id": pdf["group_id"], "n": pdf["n"], "observed": (pdf["n"] * pdf["top"] - pdf["all"]).astype(float), "expected": expected})
            out["ratio"] = np.where(out["expected"] > 0, out["observed"] / out["expected"].where(out["expected"] > 0, 1.0), 0.0)
            yield out

    return facts.mapInPandas(simulate, f"group_id {kind}, n long, observed double, expected double, ratio double")


def network_report(docs: DataFrame, edges: DataFrame, weighted: DataFrame, top: int = 5000) -> dict[str, DataFrame]:
    """The sections of a network's report, by name, each a DataFrame that is computed when it is written.

    ``docs`` has doc_id, year, times_cited; ``weighted`` the edges with spx.
    """
    from .graph import degrees, node_totals
    from .structure import component_sizes, components

    kinds, totals, parts = degrees(edges), node_totals(weighted), component_sizes(components(edges))
    years = docs.select("doc_id", "year")
    return {
        "totals": corpus_totals(docs), "growth": growth(docs), "network": network_summary(edges, kinds), "components": component_histogram(parts), "largest_components": largest_components(parts),
        "links": top_links(weighted, top), "articles": article_table(docs, kinds, totals), "spx_by_year": spx_by_year(weighted, years), "spx_histogram": spx_histogram(weighted), "top_nodes": top_nodes(totals), "spx_entropy": spx_entropy(totals, years),
    }


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each section as tab-separated text with a header, in a folder of its name."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").csv(f"{path}/{name}", header=True, sep="\t")


def group_table(edges: DataFrame, members: DataFrame, groups: DataFrame, doc_paths: DataFrame, all_paths: float, links: DataFrame | None = None, least: int = 5) -> DataFrame:
    """(group_id, n_members, self_cites, in_cites, out_cites, group_paths, m_index): arcs by whether documents of one
    group cite each other, are cited or cite others; m is the group's share of paths. With ``links`` (a, b, weight), groups of
    ``least`` scholars or more only, with what ``group_network`` and ``author_groups`` tell of them.

    ``members`` has (doc_id, name); ``doc_paths`` has (doc_id, paths), the paths that go through a document's arcs.
    """
    own = members.join(groups, "name").select("doc_id", "group_id").distinct()
    a = own.select(F.col("doc_id").alias("src"), F.col("group_id").alias("ga"))
    b = own.select(F.col("doc_id").alias("dst"), F.col("group_id").alias("gb"))
    arcs = edges.select("src", "dst").join(a, "src", "left").join(b, "dst", "left")
    each = arcs.select(F.explode(F.array_distinct(F.array("ga", "gb"))).alias("group_id"), "ga", "gb").where("group_id is not null")
    same = F.col("ga").eqNullSafe(F.col("gb"))
    cites = each.groupBy("group_id").agg(F.count_if(same).alias("self_cites"), F.count_if(~same & (F.col("ga") == F.col("group_id"))).alias("in_cites"), F.count_if(~same & (F.col("gb") == F.col("group_id"))).alias("out_cites"))
    paths = own.join(doc_paths, "doc_id").groupBy("group_id").agg(F.sum("paths").alias("group_paths"))
    n = groups.groupBy("group_id").agg(F.count("*").alias("n_members"))
    out = n.join(cites, "group_id", "left").join(paths, "group_id", "left").na.fill(0)
    out = out.withColumn("m_index", F.coalesce(F.try_divide("group_paths", F.lit(float(all_paths))), F.lit(0.0)))
    return out if links is None else out.where(F.col("n_members") >= least).join(group_network(links, groups), "group_id")


def group_network(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, intra_weight, degree, weighted_degree, density, centralisation): a group's links within, and to how many other
    groups and with what weight it is linked."""
    from .networks import shrink

    ends = shrink(links, groups).select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    around = degree_centrality(ends).select(F.col("name").alias("group_id"), "degree", "weighted_degree", F.col("intra").cast("long").alias("intra_weight"))
    inner = group_density(links, groups).select("group_id", "density").join(degree_centralisation(links, groups).select("group_id", "centralisation"), "group_id")
    return inner.join(around, "group_id", "left").na.fill(0, ["degree", "weighted_degree", "intra_weight"]).select("group_id", "intra_weight", "degree", "weighted_degree", "density", "centralisation")
