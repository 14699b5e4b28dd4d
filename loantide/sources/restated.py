"""A panel whose filings arrive in batches and are amended: nothing is overwritten, a manifest tells what counts.

``<path>/batches/batch=<id>/<period>=.../`` holds the rows of each batch, ``<path>/manifest`` one row per batch, period and filing.
A batch appears when its manifest rows do, so readers see all of it or nothing, and the files of a write that was lost halfway
are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import PERIOD

ACCESSION, FILED = "accession_number", "filing_date"


def filing_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per batch, period and filing with its number of rows as ``records``; None before the first batch."""
    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_filings(panel: DataFrame, path: str, by: Sequence[str] = (), period: str = PERIOD) -> None:
    """Add the filings of ``panel`` that the snapshot does not hold yet, recognised by their accession number.

    ``panel`` has the columns ``accession_number`` and ``filing_date`` (a date) next to a date ``period``. Give columns that tell
    deals apart as ``by`` if the snapshot holds several. Running the same batch again, whole or after a failure, changes nothing. A filing is
    added whole: rows that arrive later under a known accession number are left out. Rows without accession number are an error, as
    nothing could replace them.
    """
    spark = panel.sparkSession
    known = filing_manifest(spark, path)
    named = F.when(F.col(ACCESSION).isNull(), F.raise_error(F.lit("a row has no accession number"))).otherwise(F.col(ACCESSION))
    fresh = panel.withColumn(ACCESSION, named.cast("string"))
    if known is not None:
        fresh = fresh.join(known.select(ACCESSION).distinct(), ACCESSION, "left_anti")
    batch = f"b{uuid.uuid4().hex}"  # never a number to partition discovery
    folder = f"{path}/batches/batch={batch}"
    fresh.select(*panel.columns).hint("rebalance", F.col(period)).write.partitionBy(period).parquet(folder)
    # Counted from what was written, which reads only these columns; one file, so it is committed by one rename.
    schema = panel.select(*[c for c in panel.columns if c != period], period).schema
    rows = spark.read.schema(schema).parquet(folder).groupBy(*by, period, ACCESSION, FILED).agg(F.count("*").alias("records"))
    rows.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def filings_that_count(manifest: DataFrame, by: Sequence[str] = (), period: str = PERIOD, as_of: date | None = None) -> DataFrame:
    """Per period (and ``by``) the filing filed last, up to ``as_of`` if given; ties go to the greater accession number.

    A filing without a date comes before all others and counts at no ``as_of``. If two runs wrote one filing at the same time, one copy counts.
    """
    known = manifest if as_of is None else manifest.where(F.col(FILED) <= F.lit(as_of))
    last = F.max(F.struct(FILED, ACCESSION, "batch", "records")).alias("last")
    return known.groupBy(*by, period).agg(last).select(*by, period, "last.*")


def read_restated(
    spark: SparkSession, path: str, schema: T.StructType | None = None, by: Sequence[str] = (), period: str = PERIOD, as_of: date | None = None
) -> DataFrame:
    """The panel as the latest filing of each period states it, or as it stood on the day ``as_of``.

    The filings that count are a few rows per month; Spark's size check decides on their broadcast, and the batches
    that none of them names are pruned as partitions. Filters on the period reach the folders.
    Batches may have different columns: give a ``schema``, or their schemas are merged.
    """
    manifest = filing_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"{path} holds no batch")
    counted = filings_that_count(manifest, by, period, as_of)
    keys = ["batch", ACCESSION, period, *by]
    counted = counted.select(*[F.col(k).alias(f"_{k}") for k in keys])
    if schema is None:
        reader = spark.read.option("mergeSchema", "true")
    else:
        reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())]))
    rows = reader.parquet(f"{path}/batches")
    met = [F.col(k) == F.col(f"_{k}") for k in keys[:2]] + [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys[2:]]
    return rows.join(counted, met, "left_semi").drop("batch")
