"""Helpers shared by the operators: tables, Arrow columns, the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def on_path(spark: SparkSession) -> None:
    """Let Python workers find this repository from whatever folder the driver was started."""
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known.get("PYTHONPATH")]))


#: Bytes of files up to which a table of fewer files than cores is dealt to all cores.
SMALL = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``, read by Spark. A small one in few files, which few tasks would read, is spread."""
    on_path(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL:
        return df.repartition(cores)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; on a cluster
    there is none that executors could read, and this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` written as Parquet below the shared folder and read again."""
    spark = df.sparkSession
    on_path(spark)
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many marks before it as make it no column of ``df``."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def one_row_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each doc_id: the least by text, then by all its columns as JSON. Rows without a doc_id stay.

    Only rows whose doc_id is repeated move.
    """
    docs_id = F.col("doc_id").cast("long")
    key, row = fresh(docs, "__key"), fresh(docs, "__row")
    again = settle(docs.where(docs_id.isNotNull()).groupBy(docs_id.alias(key)).count().where("count > 1").select(key))
    single = docs.join(again, docs_id == F.col(key), "left_anti")
    many = docs.join(again, docs_id == F.col(key), "left_semi")
    whole = F.struct(*columns_of(docs))
    least = many.groupBy(docs_id.alias(key)).agg(F.min_by(whole, F.struct(F.col("text").cast("string"), F.to_json(whole))).alias(row))
    return single.unionByName(least.select(*(F.col(row)[c].alias(c) for c in docs.columns)))


def byte_rows(column: pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes; null stays None."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``rows`` rows and, single long rows apart, about ``size`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * size / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def single_thread() -> None:
    """Tokenizers and BLAS get one thread in a worker, since Spark runs a worker for each core."""
    for name in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "false" if name.startswith("TOKEN") else "1")
