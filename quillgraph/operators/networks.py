"""Derived networks: who works with whom, which words go together, who cites whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(members: DataFrame, name: str = "name", first_only: bool = False) -> DataFrame:
    """(a, b, weight): pairs of names on one document with a < b, and on how many documents.

    ``members`` has (doc_id, pos, name); with ``first_only`` only names that are first on some document count.
    The rows are the pairs within documents, whose number a document's length bounds.
    """
    rows = members.select("doc_id", F.col(name).alias("name")).where("name is not null").distinct()
    if first_only:
        rows = rows.join(first_names(members, name).select("name").distinct(), "name", "left_semi")
    other = rows.select("doc_id", F.col("name").alias("b"))
    return rows.withColumnRenamed("name", "a").join(other, "doc_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def first_names(members: DataFrame, name: str = "name") -> DataFrame:
    """(doc_id, name): each document's first name; of equal positions the least name."""
    return members.groupBy("doc_id").agg(F.min(F.struct(F.col("pos"), F.col(name).alias("name"))).alias("x")).select("doc_id", "x.name")


def coauthors(doc_authors: DataFrame, first_only: bool = False) -> DataFrame:
    return pairs(doc_authors, "name", first_only)


def coassignees(doc_assignees: DataFrame, first_only: bool = False) -> DataFrame:
    return pairs(doc_assignees, "name", first_only)


def assignee_partition(assignees: DataFrame) -> DataFrame:
    """(name, partition) of (name, country, is_university): 1 and 2 for US universities and others, 3 and 4 elsewhere."""
    at_home = F.upper("country") == "US"
    part = F.when(at_home & F.col("is_university"), 1).when(at_home, 2).when(F.col("is_university"), 3).otherwise(4)
    return assignees.select("name", part.alias("partition"))


def cowords(doc_terms: DataFrame) -> DataFrame:
    """(a, b, weight): pairs of terms and how many documents have both."""
    return pairs(doc_terms.select("doc_id", F.lit(0).alias("pos"), F.col("term").alias("name")))


def coword_documents(doc_terms: DataFrame) -> DataFrame:
    """(a, b, weight): pairs of documents and how many terms they share, without a limit of documents.

    A term that n documents have gives n (n - 1) / 2 of these links: give terms of a report list, or rare ones.
    """
    rows = doc_terms.select("term", F.col("doc_id").alias("a")).distinct()
    return rows.join(rows.withColumnRenamed("a", "b"), "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def bipartite(doc_terms: DataFrame) -> DataFrame:
    """(doc_id, term, weight): a document's keywords and how often each occurs."""
    return doc_terms.groupBy("doc_id", "term").agg(F.sum("n_total").alias("weight"))


def cross_citations(edges: DataFrame, members: DataFrame, first_only: bool = False) -> DataFrame:
    """(src, dst, weight): names cited and citing, and over how many pairs of arcs and names; self-citations too."""
    rows = first_names(members) if first_only else members.select("doc_id", "name").where("name is not null").distinct()
    cited = rows.select(F.col("doc_id").alias("src"), F.col("name").alias("cited"))
    citing = rows.select(F.col("doc_id").alias("dst"), F.col("name").alias("citing"))
    return edges.select("src", "dst").join(cited, "src").join(citing, "dst").groupBy(F.col("cited").alias("src"), F.col("citing").alias("dst")).agg(F.count("*").alias("weight"))


def in_network(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``members`` whose document is an end of some arc."""
    return members.join(edges.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct(), "doc_id", "left_semi")


def shrink(links: DataFrame, groups: DataFrame, directed: bool = False) -> DataFrame:
    """(src, dst, weight): links between groups, weights summed. Links have (a, b, weight) or, directed, (src, dst, weight);
    links within a group stay, and those without direction count once."""
    a, b = ("src", "dst") if directed else ("a", "b")
    g = groups.select("name", "group_id")
    both = links.join(g.select(F.col("name").alias(a), F.col("group_id").alias("ga")), a).join(g.select(F.col("name").alias(b), F.col("group_id").alias("gb")), b)
    src, dst = (F.col("ga"), F.col("gb")) if directed else (F.least("ga", "gb"), F.greatest("ga", "gb"))
    return both.groupBy(src.alias("src"), dst.alias("dst")).agg(F.sum("weight").alias("weight"))


def partition_subnetwork(edges: DataFrame, groups: DataFrame, group_id) -> DataFrame:
    """The arcs between members of one group."""
    own = groups.where(F.col("group_id") == group_id).select("name")
    return edges.join(own.withColumnRenamed("name", "src"), "src", "left_semi").join(own.withColumnRenamed("name", "dst"), "dst", "left_semi").select(*edges.columns)
