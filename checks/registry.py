"""Registration of checks and the comparable form of their results."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(*ctes: str, sql: str | None = None):
    """Register a query under its name; ``sql`` is its twin, reading the given CTEs."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            own_folder_where_unset(spark)
            return comparable(fn(spark, sf_dir))

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = with_ctes(sql, *ctes)
        return fn

    return register


def own_folder_where_unset(spark: SparkSession) -> None:
    """On a local master without a shared folder, name one of this machine; a cluster has to name its own."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir() and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loantide-"))


def with_ctes(body: str, *ctes: str) -> str:
    if not ctes:
        return body.strip()
    recursive = "RECURSIVE " if any("UNION ALL" in c and "fold" in c for c in ctes) else ""
    return f"WITH {recursive}" + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


def comparable(df: DataFrame) -> DataFrame:
    """Dates as text, so that both engines print them alike."""
    dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# Means of cents often end on an exact half, which engines round either way.
NUDGE = 1e-9


def rounded_means(df: DataFrame, digits: int, *columns: str, nudge: float = NUDGE) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + F.lit(nudge), digits) for c in columns})
