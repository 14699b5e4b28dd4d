"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

For an item of n words, windows of n words of a document are fingerprinted as the item is. A multi-index over blocks of the
fingerprints returns every pair within the radius: with one block more than differing bits, some block agrees. Pairs are then
verified by the weighted similarity of their shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loantide.llm.common import broadcast_if_small, stored

#: Words of a shingle, least similarity, and bits in which fingerprints may differ. Windows and items have few shingles, so
#: at the least similarity about 10 of 64 bits differ, and over 19 in fewer than one of a thousand.
SHINGLE, LEAST, RADIUS = 5, 0.8, 19
_BREAKS = r"[^\p{L}\p{N}]+"


def words(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.col(text).cast("string")), _BREAKS), "")


def shingles(rows: DataFrame, words_column: str, *keep: str) -> DataFrame:
    """Rows (keep, position, h) of all shingles; texts with fewer words have none."""
    shifted = [F.col(words_column)] + [F.slice(words_column, i + 1, F.size(words_column)) for i in range(1, SHINGLE)]
    zipped = F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(shifted)])
    parts = [f"w.w{i}" for i in range(SHINGLE)]
    return (
        rows.where(F.size(words_column) >= SHINGLE)
        .select(*keep, F.posexplode(zipped).alias("position", "w"))
        .where(f"w.w{SHINGLE - 1} IS NOT NULL")
        .select(*keep, "position", F.xxhash64(*parts).alias("h"))
    )


def fingerprints(rows: DataFrame, *key: str) -> DataFrame:
    """SimHash per key over rows (key, h): a bit is 1 if set in over half the shingles. With their number as ``total``."""
    ones = [F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    bits = [
        F.when(F.col(f"b{i}") * 2 > F.col("total"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
        for i in range(64)
    ]
    counted = rows.groupBy(*key).agg(F.count("*").alias("total"), *ones)
    return counted.select(*key, "total", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def _blocks(radius: int) -> Column:
    """Array of (block, value) of ``fingerprint``: radius + 1 blocks of about equal width."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned("fingerprint", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value"),
            )
            for i, (a, b) in enumerate(zip(edges, edges[1:]))
        ]
    )


def _least_common(least: float) -> Column:
    """Shingles that a window of ``n`` words and an item need in common: c / (a + b - c) >= least solved for c."""
    both = F.least("n", "length") + F.col("n") - 2 * (SHINGLE - 1)
    return F.greatest(F.lit(1), F.ceil(both * F.lit(least / (1 + least)) - F.lit(1e-9)).cast("int"))


def _starts(last: Column) -> Column:
    """Starts of all windows over ``need`` of the sorted positions ``held``, ascending.

    Each run of ``need`` positions has a range of starts; ends of both kinds ascend, so a range goes on after the one before.
    """
    runs = F.size("held") - F.col("need")
    first = F.slice("held", F.lit(1), runs + 1)
    before = F.concat(F.array(F.lit(-1)), F.slice("held", F.lit(1), runs))
    ranges = F.transform(
        F.arrays_zip(first.alias("a"), F.slice("held", F.col("need"), runs + 1).alias("b"), before.alias("c")),
        lambda r: F.struct(
            F.greatest(F.lit(0), r["b"] - F.col("n") + SHINGLE, F.least(r["c"], last) + 1).alias("low"), F.least(r["a"], last).alias("high")
        ),
    )
    return F.flatten(F.transform(F.filter(ranges, lambda r: r["low"] <= r["high"]), lambda r: F.sequence(r["low"], r["high"])))


def leaked_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    least: float = LEAST,
    radius: int = RADIUS,
) -> DataFrame:
    """Items found in documents: one row (id, content, item, start, similarity, distance) per document and item.

    The similarity of a window and an item is the sum of the lesser over the sum of the greater counts of their shingles, whatever their
    order. Every window inside the document counts; a shorter document is one window. To be similar enough, a window has to hold a
    known number of shingles of items of its size, so fingerprints are made of the windows that do: this leaves out none that verifies.
    ``start`` counts words; the row shows the most similar window, of equals the first that aligns a shingle with an item of its size
    (starts where the item would start, moved into the document at its ends), or else the first. ``content`` hashes the text: rows alike
    in id and text are one document.

    NULL and empty texts hold nothing; items of fewer words than a shingle match nothing; repeated items with one id are one item each by
    text. Empty tables give no rows; other columns are not read. Every shingle of every text is looked up; the benchmark's are
    broadcast only when counted to be few. A passage in a third of all documents costs rows in proportion to them.
    """
    text = F.col(text_column).cast("string")
    items = benchmark.select(
        F.col(item_column).alias("item"), F.xxhash64(F.col(text_column), F.lit(1)).alias("of"), words(text_column).alias("words")
    ).distinct()
    sized = items.withColumn("n", F.size("words"))
    grams = stored(shingles(sized, "words", "item", "of", "n"), "items")
    item_prints = fingerprints(grams, "item", "of", "n")

    keyed = docs.select(F.col(id_column).alias("id"), F.xxhash64(text, F.lit(1)).alias("content"), words(text_column).alias("words"))
    known = broadcast_if_small(grams.select("h").distinct())
    found = shingles(keyed.withColumn("length", F.size("words")), "words", "id", "content", "length")
    hits = stored(found.join(known, "h", "left_semi").distinct(), "hits")
    last = F.greatest(F.lit(0), F.col("length") - F.col("n"))
    starts = F.greatest(F.lit(0), F.least(F.col("position") - F.col("q"), last))
    spots = broadcast_if_small(grams.select("h", "n", F.col("position").alias("q")).distinct())
    regions = (
        hits.join(spots, "h")
        .groupBy("id", "content", "length", "n")
        .agg(F.sort_array(F.collect_set("position")).alias("held"), F.collect_set(starts).alias("aligned"))
        .withColumn("need", _least_common(least))
        .where(F.size("held") >= F.col("need"))
        .select("id", "content", "n", "aligned", _starts(last).alias("all"))
    )
    of_kind = lambda name, flag: F.transform(name, lambda s: F.struct(F.col("n"), s.alias("start"), F.lit(flag).alias("aligned")))
    windows = regions.select("id", "content", "n", F.array_intersect("all", "aligned").alias("a"), F.array_except("all", "aligned").alias("b"))
    windows = windows.select("id", "content", F.concat(of_kind("a", True), of_kind("b", False)).alias("windows"))
    per_doc = windows.groupBy("id", "content").agg(F.flatten(F.collect_list("windows")).alias("windows"))
    per_doc = broadcast_if_small(
        stored(per_doc.select(F.col("id").alias("of_id"), F.col("content").alias("of_content"), "windows"), "windows"), 5_000
    )
    cut = (
        keyed.join(per_doc, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("content") == F.col("of_content")))
        .dropDuplicates(["id", "content"])
        .select("id", "content", "words", F.explode("windows").alias("w"))
        .select("id", "content", "w.*", F.slice("words", F.col("w.start") + 1, F.col("w.n")).alias("words"))
    )
    window = ["id", "content", "n", "start", "aligned"]
    parts = stored(shingles(cut, "words", *window).select(*window, "h"), "shingles")
    prints = stored(fingerprints(parts, *window), "prints")
    indexed = lambda df: df.withColumn("b", F.explode(_blocks(radius))).select("*", "b.*").drop("b")
    other = indexed(item_prints.withColumnRenamed("fingerprint", "item_print").withColumn("fingerprint", F.col("item_print")))
    other = broadcast_if_small(stored(other.drop("fingerprint").withColumnRenamed("total", "item_total"), "blocks"))
    near = (
        indexed(prints)
        .join(other, ["n", "block", "value"])
        .withColumn("distance", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))))
        .where(F.col("distance") <= radius)
        .select(*window, "total", "item", "of", "item_total", "distance")
        .distinct()
    )
    mine = parts.groupBy(*window, "h").agg(F.count("*").alias("c"))
    theirs = broadcast_if_small(stored(grams.groupBy("item", "of", "h").agg(F.count("*").alias("ci")), "items"))
    same = [near[c].eqNullSafe(mine[c]) for c in ("id", "content", "n", "start")]
    met = near.join(mine, reduce(lambda a, b: a & b, same)).select(
        *[near[c] for c in window], "total", "item", "of", "item_total", "distance", "h", "c"
    )
    t = theirs.select(F.col("item").alias("t_item"), F.col("of").alias("t_of"), F.col("h").alias("t_h"), "ci")
    common = (
        met.join(t, (F.col("h") == F.col("t_h")) & (F.col("of") == F.col("t_of")) & F.col("item").eqNullSafe(F.col("t_item")))
        .groupBy(*window, "item", "of", "total", "item_total", "distance")
        .agg(F.sum(F.least("c", "ci")).alias("common"))
    )
    similarity = F.col("common") / (F.col("total") + F.col("item_total") - F.col("common"))
    best = F.max(F.struct("similarity", "aligned", (-F.col("start")).alias("back"), (-F.col("distance")).alias("close")))
    return (
        common.withColumn("similarity", similarity)
        .where(F.col("similarity") >= least)
        .groupBy("id", "content", "item")
        .agg(best.alias("best"))
        .select(
            F.col("id").alias(id_column),
            "content",
            F.col("item").alias(item_column),
            (-F.col("best.back")).alias("start"),
            "best.similarity",
            (-F.col("best.close")).alias("distance"),
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id"
) -> DataFrame:
    """The documents, all columns unchanged, without those in which an item of the benchmark is found."""
    leaks = leaked_items(docs, benchmark, id_column, text_column, item_column)
    bad = broadcast_if_small(
        stored(leaks.select(F.col(id_column).alias("bad_id"), F.col("content").alias("bad_content")).distinct(), "leaks")
    )
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[id_column].alias("id"),
        F.xxhash64(docs[text_column].cast("string"), F.lit(1)).alias("content"),
    )
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("content") == F.col("bad_content"))
    return rows.join(bad, same, "left_anti").select("row.*")
