"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a small side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the context's checkpoint folder where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and lost executors cost nothing.

    The files go when the application ends; ``drop_stored`` removes them earlier.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where, files = _file_system(spark, path)
    df.write.parquet(path)
    files.deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def stored_more(before: DataFrame | None, df: DataFrame, name: str) -> DataFrame:
    """The rows of ``before``, a result of this function or None, and those of ``df``: files of one folder, so a table that grows in rounds stays one scan."""
    if before is None:
        return stored(df, name)
    path = before._stored_at
    df.select(*before.columns).write.mode("append").parquet(path)
    back = df.sparkSession.read.schema(before.schema).parquet(path)
    back._stored_at = path
    return back


def drop_stored(df: DataFrame) -> None:
    """Remove the files behind a result of :func:`stored` that nothing reads any more."""
    where, files = _file_system(df.sparkSession, df._stored_at)
    files.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df``, cheap to read, has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(links: DataFrame) -> DataFrame:
    """Connected components of the undirected links (a, b): one row (node, root) per node other than its root.

    The root is the least node. Alternates large-star and small-star steps: every node
    moves its neighbours to its least neighbour, so paths shrink geometrically. A hub's links are
    aggregated on the map side; the join that returns the minimum to them is one that adaptive
    execution splits. Only a row count and a checksum reach the driver.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        "links",
    )
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Stored, as adaptive execution splits a hub's links only where both sides of a join are plain shuffles.
        least = stored(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), "links")
        large = (
            both.join(least, "v").where("u > v and u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        )
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(lower, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = stored(lower.withColumnRenamed("m", "u").unionByName(moved).distinct(), "links")
        signature = _signature(after)
        drop_stored(edges)
        drop_stored(least)
        edges = after
        if signature == before:
            break
        before = signature
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, u))")).first())
