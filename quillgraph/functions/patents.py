"""Patent classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.kernel import cut

#: Pairs of class and industry up to which a concordance goes to every task.
PAIRS = 500_000
#: Rows of documents and industries that are ranked at once.
ROWS = 1_000_000


def truncated(code: Column, to: int | str) -> Column:
    """A class code's first ``to`` (4, 5 or 6) characters, or what stands before its slash."""
    return F.substring_index(code, "/", 1) if to == "/" else F.substring(code, 1, int(to))


def industries(codes: DataFrame, concordance: DataFrame, first: int | None = None) -> DataFrame:
    """(doc_id, isic, percent, rank): for each document the mean share of each industry over its codes' rows; with
    ``first`` those of rank ``first`` at most.

    ``codes`` has (doc_id, ipc), ``concordance`` (ipc, isic, percent), of which rows of one class and industry are summed
    before codes meet them. A table of up to ``PAIRS`` such pairs goes to the documents, so that no pair of document and
    industry is shuffled.
    """
    table = cut(concordance.where("ipc is not null").groupBy("ipc", "isic").agg(F.sum("percent").cast("double").alias("sum"), F.count("percent").alias("n")))
    if table.count() <= PAIRS:
        return _ranked(codes, table, first)
    mean = F.sum("sum") / F.nullif(F.sum("n"), F.lit(0))
    shares = codes.join(table, "ipc").groupBy("doc_id", "isic").agg(mean.alias("percent"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("percent"), "isic")  # a document has few industries
    out = shares.withColumn("rank", F.row_number().over(order))
    return out if first is None else out.where(F.col("rank") <= first)


def _ranked(codes: DataFrame, table: DataFrame, first: int | None) -> DataFrame:
    """``industries`` of a small table, by arrays: classes as numbers, industries as numbers in their order."""
    spark, pairs = codes.sparkSession, table.toArrow().combine_chunks()
    ipc, isic = (pc.unique(pairs[c]) for c in ("ipc", "isic"))
    isic = isic.take(pc.array_sort_indices(isic, null_placement="at_start"))
    # null is an industry, as any value
    of, to = pc.index_in(pairs["ipc"], ipc).to_numpy(), pc.index_in(pairs["isic"], isic).to_numpy()
    order = np.argsort(of, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(of, minlength=len(ipc))))
    shared = spark.sparkContext.broadcast((isic, starts, to[order].astype(np.int64), pc.fill_null(pairs["sum"], 0.0).to_numpy()[order], pairs["n"].to_numpy()[order]))
    text, kind = table.schema["ipc"].dataType.simpleString(), codes.schema["doc_id"].dataType.simpleString()
    numbers = spark.createDataFrame(pa.table({"ipc": ipc, "no": pa.array(np.arange(len(ipc)), pa.int32())})).select(F.col("ipc").cast(text).alias("ipc"), "no")
    rows = codes.join(F.broadcast(numbers), "ipc").select("doc_id", "no").repartition("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        isic, starts, to, sums, counts = shared.value
        for ids, doc, no in _documents(batches, np.diff(starts)):
            n = (starts[no + 1] - starts[no]).astype(np.int64)
            at = np.repeat(starts[no] - np.cumsum(n) + n, n) + np.arange(n.sum())
            key = np.repeat(doc, n) * len(isic) + to[at]
            order = np.argsort(key)
            key, at = key[order], at[order]
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            total, count = np.add.reduceat(sums[at], edge), np.add.reduceat(counts[at], edge)
            mean = np.divide(total, count, out=np.full(len(edge), np.nan), where=count > 0)
            doc, industry = np.divmod(key[edge], len(isic))
            # means from the largest, NaN before and null after all; ties by industry
            by = np.argsort(np.where(count == 0, np.nan, np.where(np.isnan(mean), -np.inf, -mean)), kind="stable")
            by = by[np.argsort(doc[by].astype(np.uint16 if len(ids) < 1 << 16 else np.int64), kind="stable")]
            doc = doc[by]
            rank = np.arange(1, len(doc) + 1) - np.searchsorted(doc, doc)
            if first is not None:
                few = rank <= first
                doc, by, rank = doc[few], by[few], rank[few]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), isic.take(pa.array(industry[by])), pa.array(mean[by], mask=count[by] == 0), pa.array(rank, pa.int32())], ["doc_id", "isic", "percent", "rank"])

    return rows.mapInArrow(run, f"doc_id {kind}, isic {table.schema['isic'].dataType.simpleString()}, percent double, rank int")


def _documents(batches: Iterator[pa.RecordBatch], sizes: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, doc, no) of whole documents, whose rows follow each other: doc numbers within ids and the classes' numbers."""
    left = None
    for b in batches:
        if left is not None:
            b = pa.concat_batches([left, b])
        runs = pc.run_end_encode(b.column(0))
        ends = runs.run_ends.to_numpy().astype(np.int64)
        last = int(ends[-2]) if len(ends) > 1 else 0
        yield from _chunks(runs.values, ends[:-1], b.column(1).to_numpy()[:last], sizes)
        left = b.slice(last)
    if left is not None and len(left):
        yield from _chunks(left.column(0).slice(0, 1), np.array([len(left)]), left.column(1).to_numpy(), sizes)


def _chunks(ids: pa.Array, ends: np.ndarray, no: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Documents that have about ``ROWS`` rows of the table in all."""
    made = np.append(0, np.cumsum(sizes[no]))[ends]
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(made, (made[i - 1] if i else 0) + ROWS, "right")))
        p, q = (int(ends[i - 1]) if i else 0), int(ends[j - 1])
        yield ids.slice(i, j - i), np.repeat(np.arange(j - i), np.diff(np.append(p, ends[i:j]))), no[p:q]
        i = j


def collaboration(members: DataFrame, university: Column) -> DataFrame:
    """(doc_id, kind): UU, UUI or UI by how many of a document's assignees are universities; null for others."""
    n = members.groupBy("doc_id").agg(F.count_if(university).alias("u"), F.count_if(~university).alias("i"))
    kind = F.when((F.col("u") >= 2) & (F.col("i") == 0), "UU").when((F.col("u") >= 2) & (F.col("i") >= 1), "UUI").when((F.col("u") == 1) & (F.col("i") >= 1), "UI")
    return n.select("doc_id", kind.alias("kind"))
