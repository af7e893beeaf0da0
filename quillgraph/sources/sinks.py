"""Writers: edge lists, Pajek networks, tables of links, selected records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_edges(edges: DataFrame, path: str, with_weight: bool = False) -> None:
    """Lines ``  cited citing [weight]``, a part for each partition."""
    cols = [F.col("src").cast("string"), F.col("dst").cast("string")] + ([F.col("weight").cast("string")] if with_weight else [])
    edges.select(F.concat(F.lit("  "), F.concat_ws(" ", *cols)).alias("value")).write.mode("overwrite").text(path)


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with id from 1, by name: ids within ranges, and the ranges' sizes before them."""
    ranged = nodes.repartitionByRange("node").sortWithinPartitions("node").withColumn("__p", F.spark_partition_id())
    ranged = ranged.checkpoint() if nodes.sparkSession.sparkContext.getCheckpointDir() else ranged.persist()
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row for each partition
    inside = Window.partitionBy("__p").orderBy("node")
    return ranged.join(F.broadcast(before), "__p").withColumn("id", (F.row_number().over(inside) + F.col("__before")).cast("long")).drop("__p", "__before")


def pajek_lines(nodes: DataFrame, edges: DataFrame, directed: bool = True, partition: DataFrame | None = None) -> DataFrame:
    """(section, at, value): a Pajek file's lines in order. ``nodes`` has node and alias; ``partition`` node and partition."""
    ids = numbered(nodes)
    n = ids.agg(F.count("*").alias("n"))
    head = n.select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("at"), F.format_string("*Vertices %d", "n").alias("value"))
    vertices = ids.select(F.lit(1).alias("section"), F.col("id").alias("at"), F.concat(F.col("id").cast("string"), F.lit(' "'), F.regexp_replace(F.col("alias").cast("string"), '"', "'"), F.lit('"')).alias("value"))
    mark = n.select(F.lit(2).alias("section"), F.lit(0).cast("long").alias("at"), F.lit("*Arcs" if directed else "*Edges").alias("value"))
    a, b = ids.select(F.col("node").alias("src"), F.col("id").alias("s")), ids.select(F.col("node").alias("dst"), F.col("id").alias("d"))
    links = edges.join(a, "src").join(b, "dst").select(F.lit(3).alias("section"), F.col("s").alias("at"), F.format_string("%d %d %s", "s", "d", F.regexp_replace(F.col("weight").cast("double").cast("string"), r"\.0$", "")).alias("value"))
    out = head.unionByName(vertices).unionByName(mark).unionByName(links)
    if partition is not None:
        out = out.unionByName(n.select(F.lit(4).alias("section"), F.lit(0).cast("long").alias("at"), F.format_string("*Partition groups\n*Vertices %d", "n").alias("value")))
        out = out.unionByName(ids.join(partition, "node", "left").select(F.lit(5).alias("section"), F.col("id").alias("at"), F.coalesce(F.col("partition").cast("string"), F.lit("999999")).alias("value")))
    return out


def write_pajek(path: str, nodes: DataFrame, edges: DataFrame, directed: bool = True, partition: DataFrame | None = None) -> None:
    """One Pajek file. The format wants its lines in one file and order, so the last step is a single task: for networks
    that a desktop program can open."""
    pajek_lines(nodes, edges, directed, partition).orderBy("section", "at", "value").coalesce(1).select("value").write.mode("overwrite").text(path)


def link_table(weighted: DataFrame) -> DataFrame:
    """(source, target, value): arcs whose spx isn't zero."""
    return weighted.where("spx <> 0").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("spx").alias("value"))


def write_link_table(weighted: DataFrame, path: str) -> None:
    link_table(weighted).write.mode("overwrite").csv(path, header=True)


def select_records(records: DataFrame, key: str, groups: DataFrame, group_id: int = 99_999) -> DataFrame:
    """The original records of a group's documents, each id once; 99999 is every group. ``groups`` has (name, group_id)."""
    own = groups if group_id == 99_999 else groups.where(F.col("group_id") == group_id)
    return records.join(own.select(F.col("name").alias(key)).distinct(), key, "left_semi").dropDuplicates([key]).select(*records.columns)


def bipartite_lines(links: DataFrame, path: str) -> None:
    """Lines of document, term and weight, tab-separated."""
    links.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in links.columns[:3])).alias("value")).write.mode("overwrite").text(path)
