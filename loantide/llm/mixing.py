"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loantide.llm.common import broadcast_if_small, stored

#: Bins of the sampling key per source and level; two levels leave a source's 16 millionth part in one bin.
BINS = 4096


def word_count(text: str = "text") -> Column:
    """Number of words between spaces, tabs and line ends; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def letter_share(text: str = "text") -> Column:
    """Quality weight of a text between 0.05 and 1: the share of its characters that are neither digits nor signs."""
    signs = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    length = F.length(text)
    kept = F.length(F.translate(F.col(text), signs, ""))
    return F.greatest(F.coalesce(F.try_divide(kept.cast("double"), length), F.lit(0.0)), F.lit(0.05))


def uniform(key: Column, seed: int) -> Column:
    """Number strictly between 0 and 1 from a text key, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total: float, cap: float) -> DataFrame:
    """Target size of each source: ``total`` times all sizes shared by weight, none above ``cap`` times its own size.

    ``sizes`` has one row per source (source, source_size, rank) with ranks from 0; weights repeat by rank. What a capped source
    leaves is shared anew by weight. A source is capped when its size per weight lies below the common level, so with sources in
    that order the first that is not capped has the common level, from running sums over the sources.
    """
    weighted = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.col("source_size").cast("double")
    levels = (
        weighted.withColumn("ratio", F.col("source_size") / F.col("w"))
        .withColumn("capped", F.coalesce(F.sum(share * cap).over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum(share).over(every) * total - F.col("capped")) / F.col("rest"))
        .withColumn("open", F.col("level") * F.col("w") <= share * cap)
        .withColumn("first", F.min(F.when(F.col("open"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    )
    target = F.least(share * cap, F.coalesce(F.col("first") * F.col("w"), share * cap))
    return levels.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    size: Column | None = None,
    weight: Column | None = None,
    shares: tuple[float, ...] = (3.0, 1.0, 2.0),
    total: float = 1.5,
    cap: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """What a mix takes of each document: id, source, size, source_size, target, epochs, taken.

    Sources stand in code point order, NULL last. Whole epochs of a source come first: ``epochs`` is the whole part
    of target over source size. The rest is drawn without replacement by exponential keys: a document of weight w
    gets -ln(u) / w, and the least keys are taken while the running size stays within the rest; of the document that crosses it
    the words up to the rest are taken. Keys come from a digest of seed and id (of the text where the id is NULL), so reruns
    agree; equal keys are ordered by size, and rows alike in id and size may stand for each other.

    No source is sorted in one task: running sums over two levels of key bins per source find the bin that
    holds the boundary, and only its documents are ordered. NULL texts have size 0, and a source without words takes 0 of each
    document. An empty table gives no rows; other columns are not read.
    """
    size = word_count(text_column) if size is None else size
    weight = letter_share(text_column) if weight is None else weight
    drawn_by = F.coalesce(F.col(id_column).cast("string"), F.md5(F.col(text_column).cast("string").cast("binary")))
    key = -F.log(uniform(F.col("drawn_by"), seed)) / F.col("weight")
    # Both bins follow the share 1 - exp(-key) that a key of weight 1 has, so that they fill evenly.
    place = (F.lit(1.0) - F.exp(-F.col("key"))) * BINS
    slim = (
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            size.alias("size"),
            weight.cast("double").alias("weight"),
            drawn_by.alias("drawn_by"),
        )
        .withColumn("key", key)
        .withColumn("high", F.least(F.floor(place), F.lit(BINS - 1)).cast("int"))
        .withColumn("low", F.least(F.floor((place - F.floor(place)) * BINS), F.lit(BINS - 1)).cast("int"))
        .drop("weight", "drawn_by")
    )
    slim = stored(slim, "mixing")
    bins = slim.groupBy("source", "high").agg(F.sum("size").alias("size"))
    by_source = bins.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    plan = (
        source_targets(by_source.withColumn("rank", rank), shares, total, cap)
        .withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("start", F.lit(0).cast("long"))
    )
    plan = broadcast_if_small(stored(_with_crossing(plan, bins, "high"), "mixing"))
    crossed = _of_source(slim, plan.select("source", "cut_high")).where("high = cut_high")
    plan = _with_crossing(plan, crossed.groupBy("source", "low").agg(F.sum("size").alias("size")), "low")
    plan = broadcast_if_small(stored(plan, "mixing"))

    rows = _of_source(slim, plan)
    at_cut = "(high = cut_high AND low = cut_low)"
    below = F.expr("CASE WHEN high < cut_high OR (high = cut_high AND low < cut_low) THEN 1 ELSE 0 END") * F.col("size")
    clear = rows.where(f"NOT coalesce({at_cut}, false)").withColumn("drawn", below)
    order = Window.partitionBy("source").orderBy("key", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0))
    within = F.least(F.greatest(F.floor(F.col("rest") - before), F.lit(0)), F.col("size"))
    edge = rows.where(at_cut).withColumn("drawn", within)
    return clear.unionByName(edge).select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "size",
        "source_size",
        "target",
        "epochs",
        (F.col("epochs") * F.col("size") + F.col("drawn")).alias("taken"),
    )


def _of_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan_source = plan.withColumnRenamed("source", "plan_source")
    return rows.join(plan_source, rows["source"].eqNullSafe(plan_source["plan_source"])).drop("plan_source")


def _with_crossing(plan: DataFrame, bins: DataFrame, level: str) -> DataFrame:
    """Add ``cut_<level>``, the bin of each source in which the running size passes ``rest``, and the size before it as ``start``."""
    order = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    run = _of_source(bins, plan.select("source", "start", "rest")).withColumn(
        "start", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0))
    )
    cut = run.where("start <= rest AND start + size > rest").select(
        F.col("source").alias("cut_source"), F.col(level).alias(f"cut_{level}"), F.col("start").alias("cut_start")
    )
    return (
        plan.join(cut, plan["source"].eqNullSafe(cut["cut_source"]), "left")
        .withColumn("start", F.coalesce("cut_start", "start"))
        .drop("cut_source", "cut_start")
    )
