"""Removal of repeated lines by overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loantide.llm.common import stored


def drop_repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = 3,
    count_column: str | None = "removed_lines",
) -> DataFrame:
    """The documents with all columns, the text without repeated windows, and the number of lines removed as ``count_column``.

    Every ``window`` consecutive lines of a document form a window. Windows with the same lines repeat each other wherever
    they stand; the first by document (id, NULL last, then text hash) and position stays. The lines covered by any later window are
    removed, the others are joined again by line ends. Windows of blank lines only do not count, and a document of fewer lines is
    left alone.

    Rows alike in id and text are one document: they get the same text, and do not repeat each other. NULL texts stay NULL, with 0
    removed lines; an empty table gives no rows. A column named as ``count_column`` is replaced, other names cannot clash.

    Windows travel as 128-bit digests, never as text. Counts of a repeated window are aggregated on the map side, and only digests
    that repeat go back to their places; the join on them is one that adaptive execution splits at a frequent
    window. Texts move once, to meet the positions to remove.
    """
    text = F.col(text_column).cast("string")
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[id_column].alias("id"),
        F.xxhash64(text, F.lit(1)).alias("content"),
        text.alias("text"),
    )
    # One digest per line, then one per window from the digests of its lines.
    lines = keyed.select(
        "id",
        "content",
        F.transform(F.split("text", "\n"), lambda line: F.struct(F.xxhash64(line), F.xxhash64(F.lit(5), line), F.trim(line) == "")).alias("lines"),
    ).where(F.size("lines") >= window)
    at = lambda i, k, part: F.get("lines", i + k)[part]
    starts = F.sequence(F.lit(0), F.size("lines") - window)

    def digest(i):
        blank = at(i, 0, "col3")
        for k in range(1, window):
            blank = blank & at(i, k, "col3")
        return F.struct(
            i.alias("start"),
            F.xxhash64(*[at(i, k, "col1") for k in range(window)]).alias("h1"),
            F.xxhash64(*[at(i, k, "col2") for k in range(window)]).alias("h2"),
            blank.alias("blank"),
        )

    windows = (
        lines.select("id", "content", F.explode(F.transform(starts, digest)).alias("w"))
        .where("NOT w.blank")
        .select("id", "content", "w.start", "w.h1", "w.h2")
    )
    place = F.struct(F.col("id").isNull().alias("missing"), "id", "content", "start")
    repeated = stored(
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last")
        .select("h1", "h2", "first"),
        "windows",
    )
    later = windows.join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    covered = (
        later.groupBy("id", "content")
        .agg(F.collect_set("start").alias("starts"))
        .select(F.col("id").alias("of_id"), F.col("content").alias("of_content"), "starts")
    )
    met = keyed.join(
        covered, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("content") == F.col("of_content")), "left"
    )
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + window - 1))))
    split = F.split("text", "\n")
    kept = F.filter(split, lambda line, i: ~F.array_contains(F.col("gone"), i))
    changed = F.col("gone").isNotNull()
    new_text = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text"))
    removed = F.when(changed, F.size("gone")).otherwise(0)
    columns = [
        new_text.alias(c) if c == text_column else F.col("row").getField(c).alias(c)
        for c in docs.columns
        if c != count_column
    ]
    return met.withColumn("gone", gone).select(*columns, *([removed.alias(count_column)] if count_column else []))
