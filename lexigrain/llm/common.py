"""Pieces shared by the operators: shared storage, gear hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that setting
    is absent (local mode, tests) a temporary folder of this machine is used.
    """
    path = spark.conf.get(_CHECKPOINT, None)
    if path is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            path = known.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            path = tempfile.mkdtemp(prefix="lexigrain-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set(_CHECKPOINT, path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lexigrain/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage and survives lost executors; the schema is passed so
    that an empty result can be read as well.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes everything ``materialise`` wrote, once no lazy result needs it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lexigrain")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 512, size: str = "32m") -> None:
    """Bounds an Arrow batch by rows and by bytes: documents can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, null text as the empty text."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values by the splitmix64 rule."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


GEAR = (_splitmix(256, 20) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray, doublings: int = 4) -> np.ndarray:
    """The gear rolling hash at each byte over the 2**doublings bytes up to it.

    The recurrence h(i) = 2 h(i-1) + GEAR[b(i)] is evaluated for all positions
    at once: a window of 2w bytes is two windows of w bytes, one shifted.
    """
    h = GEAR[data]
    for k in range(doublings):
        w = 1 << k
        if w >= len(h):
            break
        grown = h.copy()
        grown[w:] += h[:-w] << np.uint32(w)
        h = grown
    return h


def trimmed(store: dict, limit: int) -> dict:
    """The newer half of a store of more than ``limit`` entries, in a new dictionary."""
    return dict(islice(store.items(), len(store) // 2, None)) if len(store) > limit else store


def join_on_key(rows: DataFrame, table: DataFrame, key: str, held: str, spread: str, share: int = 4096, salts: int = 64) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a ``key`` and in ``held`` how many rows hold that key.

    Keys that more than one row in ``share`` holds are at most ``share`` keys,
    so they may be broadcast; their rows are dealt to ``salts`` parts by a hash
    of ``spread``, and their rows of ``table`` go to each part.  ``table``
    should be stored, as it is read three times.  ``held`` is not returned.
    """
    total = table.agg(F.sum(held)).first()[0] or 0
    hot = F.col(held) > total / share
    marks = F.broadcast(table.where(hot).select(key, F.lit(salts).alias("_parts")))
    left = rows.join(marks, key, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    parts = F.sequence(F.lit(0), F.when(hot, F.lit(salts - 1)).otherwise(F.lit(0)))
    right = table.withColumn("_salt", F.explode(parts)).drop(held)
    return left.join(right, [key, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b).

    Alternating large-star and small-star steps; root is the smallest node of
    the component.  Each round is aggregation and equi-joins on the links only
    and is written to the shared folder, so no links reach the driver.  Nodes
    without links are absent.  Empty input gives an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, label)
    seen = None
    while True:
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen or sign[0] == 0:
            break
        seen = tuple(sign)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("lo"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("lo").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("lo"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("lo").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("lo").alias("b")),
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        e = materialise(small, label)
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
