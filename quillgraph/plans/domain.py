"""The test tables as bibliographic ones: what the registered queries run on.

An order is a document (its year is the order's), its suppliers are the authors (first: the least line number, then the
name), their nations the assignees, a market segment the journal, a part's brand the class and the words of its name the
keywords. An order cites one of the year before if both have a part from one supplier: a layered network without cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import cut


class Domain:
    """Views of the tables below ``sf_dir``; each is read lazily and prunes its columns."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def years(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"))

    def items(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"))

    def edges(self) -> DataFrame:
        """The layered network, computed once."""
        rows = self.items().select("part", "supp", "doc_id").distinct().join(self.years(), "doc_id")
        later = rows.select("part", "supp", (F.col("year") - 1).alias("year"), F.col("doc_id").alias("dst"))
        return cut(rows.withColumnRenamed("doc_id", "src").join(later, ["part", "supp", "year"]).select("src", "dst").distinct().withColumn("weight", F.lit(1.0)))

    def chain_with_loops(self) -> DataFrame:
        """Consecutive (order, supplier) rows of a part, in order of date: has self-loops and parallel arcs."""
        from pyspark.sql import Window

        rows = self.items().select("part", "supp", "doc_id").distinct().join(self.table("orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate"), "doc_id")
        order = Window.partitionBy("part").orderBy("o_orderdate", "doc_id", "supp")
        return rows.select(F.lag("doc_id").over(order).alias("src"), F.col("doc_id").alias("dst")).where("src is not null")

    def authors(self) -> DataFrame:
        who = self.items().groupBy("doc_id", "supp").agg(F.min("line").alias("pos"))
        return who.join(self.table("supplier").select(F.col("s_suppkey").alias("supp"), F.col("s_name").alias("name")), "supp").select("doc_id", "pos", "name")

    def assignees(self) -> DataFrame:
        """(doc_id, pos, name, country, is_university, area): nations of suppliers, their regions, even ones as universities; the
        area is the rest of a nation's number divided by three, and none for zero."""
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        place = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supp"), F.col("n_name").alias("name"), F.col("r_name").alias("country"), (F.col("n_nationkey") % 2 == 0).alias("is_university"), F.nullif((F.col("n_nationkey") % 3).cast("string"), F.lit("0")).alias("area"))
        return self.items().join(place, "supp").groupBy("doc_id", "name", "country", "is_university", "area").agg(F.min("line").alias("pos")).select("doc_id", "pos", "name", "country", "is_university", "area")

    def author_places(self) -> DataFrame:
        """(doc_id, pos, name, country): authors with the nations that they are of."""
        where = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.col("n_name").alias("country"))
        return self.authors().join(where, "name").select("doc_id", "pos", "name", "country")

    def areas(self) -> DataFrame:
        """(country, area): nations and their regions."""
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("country"), F.col("r_name").alias("area"))

    def documents(self, edges: DataFrame) -> DataFrame:
        """(doc_id, year, alias, times_cited, n_authors, n_countries)."""
        cited = edges.groupBy(F.col("src").alias("doc_id")).agg(F.count("*").cast("int").alias("times_cited"))
        n = self.items().groupBy("doc_id").agg(F.countDistinct("supp").alias("n_authors"))
        places = self.assignees().groupBy("doc_id").agg(F.countDistinct("name").alias("n_countries"))
        out = self.years().join(cited, "doc_id", "left").join(n, "doc_id", "left").join(places, "doc_id", "left")
        return out.select("doc_id", "year", F.col("doc_id").cast("string").alias("alias"), F.coalesce("times_cited", F.lit(0)).alias("times_cited"), F.coalesce("n_authors", F.lit(0)).alias("n_authors"), F.coalesce("n_countries", F.lit(0)).alias("n_countries"))

    def codes(self) -> DataFrame:
        """(doc_id, ipc): a row for each distinct part of an order; the class is its brand and, after a slash, its size."""
        part = self.table("part").select(F.col("p_partkey").alias("part"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("ipc"))
        return self.items().select("part", "doc_id").distinct().join(part, "part").select("doc_id", "ipc")

    def concordance(self) -> DataFrame:
        """(ipc, isic, percent)."""
        return self.table("part").select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("ipc"), F.col("p_type").alias("isic"), F.col("p_size").cast("double").alias("percent"))

    def keywords(self) -> DataFrame:
        """(doc_id, term, n_total): words of the names of an order's parts."""
        words = self.table("part").select(F.col("p_partkey").alias("part"), F.explode(F.split("p_name", " ")).alias("term"))
        return self.items().select("part", "doc_id").distinct().join(words, "part").groupBy("doc_id", "term").agg(F.count("*").alias("n_total"))

    def texts(self) -> DataFrame:
        """(doc_id, title, abstract): the first line of a document's text, and the rest."""
        t = self.table("documents").select("doc_id", F.split("text", "\n", 2).alias("t"))
        return t.select("doc_id", F.get("t", F.lit(0)).alias("title"), F.get("t", F.lit(1)).alias("abstract"))

    def families(self) -> DataFrame:
        """(family_id, doc_id): customers with orders in the network are families of those orders."""
        return self.table("orders").where("o_custkey % 3 = 0 and o_custkey > 0").select(F.col("o_custkey").alias("family_id"), F.col("o_orderkey").alias("doc_id"))

    def vectors(self) -> DataFrame:
        """(doc_id, a, b): pairs of count vectors, from embeddings."""
        e = self.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: F.floor(F.abs(x) * 10).cast("double")).alias("v"))
        nxt = e.select((F.col("doc_id") - 1).alias("doc_id"), F.col("v").alias("b"))
        return e.join(nxt, "doc_id").select("doc_id", F.col("v").alias("a"), "b")
