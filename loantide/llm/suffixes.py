"""Repeated passages by a sparse suffix array.

Suffixes are retained where content selects them: at the least hash of each window of word grams (its minimiser). Any two equal
passages of ``passage`` words hold the same minimisers, so retained suffixes are sorted by their first words, neighbours with the
same ones are compared, and matches grow to the left and right: every passage-long window belongs to one retained
suffix, which carries a digest of the whole stretch of its windows. Stretches that agree match as a whole; where suffixes agree and
stretches do not, their windows are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from loantide.llm.common import drop_stored, stored

#: Words of the gram by which suffixes are selected and sorted.
GRAM = 12
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Stretches:
    """128-bit digests of any stretch of a text's words, from running sums modulo 2**64."""

    def __init__(self, words: list[bytes]) -> None:
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in words), np.uint64, len(words))
        self.sums, self.back = [], []
        for base, own in zip(_BASES, (hashes, _mixed(hashes))):
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(own * _powers(base, len(words))[:-1], out=sums[1:])
            self.sums.append(sums)
            self.back.append(_powers(pow(base, -1, 1 << 64), len(words)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = (_mixed((s[ends] - s[starts]) * b[starts]) for s, b in zip(self.sums, self.back))
        return tuple(x.view(np.int64) for x in both)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def retained(words: list[bytes], passage: int, gram: int) -> tuple[Stretches, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests of a text of at least ``passage`` words, and of each retained suffix its key, the first window that belongs to it,
    their number, and its position."""
    stretches = Stretches(words)
    at = np.arange(len(words) - gram + 1)
    keys = stretches.of(at, at + gram)[0]
    window = passage - gram + 1
    order = keys.view(np.uint64)
    chosen = np.concatenate(
        [
            np.lib.stride_tricks.sliding_window_view(order[a : a + (1 << 20) + window - 1], window).argmin(axis=1)
            + np.arange(a, min(a + (1 << 20), len(order) - window + 1))
            for a in range(0, len(order) - window + 1, 1 << 20)
        ]
    )
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    counts = np.diff(np.concatenate([first, [len(chosen)]]))
    return stretches, keys[chosen[first]], first, counts, chosen[first]


def _suffixes(docs: DataFrame, passage: int, gram: int) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("g1", T.LongType()),
            T.StructField("g2", T.LongType()),
            T.StructField("n", T.IntegerType()),
            docs.schema["id"],
            T.StructField("content", T.LongType()),
            T.StructField("start", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], [[], [], [], [], []]
            for i, text in enumerate(batch.column(2)):
                words = (text.as_py() or b"").split()
                if len(words) >= passage:
                    stretches, keys, first, counts, _ = retained(words, passage, gram)
                    for part, values in zip(parts, (keys, *stretches.of(first, first + counts + passage - 1), counts, first)):
                        part.append(values)
                    rows.append(np.full(len(keys), i))
            if rows:
                key, g1, g2, n, start = (np.concatenate(p) for p in parts)
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(g1), pa.array(g2), pa.array(n.astype(np.int32))]
                    + [batch.column(0).take(row), batch.column(1).take(row), pa.array(start.astype(np.int32))],
                    names=schema.names,
                )

    return docs.select("id", "content", F.col("text").cast("binary")).mapInArrow(run, schema)


def _windows(docs: DataFrame, wanted: DataFrame, passage: int) -> DataFrame:
    """Digests of single windows: per wanted (id, content, classes of start, n, class) rows (class, offset, h1, h2, place)."""
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("g1", "g2", "h1", "h2")]
        + [T.StructField("offset", T.IntegerType()), T.StructField("start", T.IntegerType())]
        + [docs.schema["id"], T.StructField("content", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, classes) in enumerate(zip(batch.column(0), batch.column(1))):
                stretches = Stretches((text.as_py() or b"").split())
                out = []
                for c in classes.as_py():
                    offsets = np.arange(c["n"], dtype=np.int32)
                    starts = offsets + np.int32(c["start"])
                    h1, h2 = stretches.of(starts, starts + passage)
                    out.append((np.full(c["n"], c["g1"]), np.full(c["n"], c["g2"]), h1, h2, offsets, starts))
                columns = [pa.array(np.concatenate(x)) for x in zip(*out)]
                row = pa.array(np.full(len(columns[0]), i))
                columns += [batch.column(2).take(row), batch.column(3).take(row)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    met = docs.join(
        wanted, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("content") == F.col("of_content"))
    ).dropDuplicates(["id", "content"])
    return met.select(F.col("text").cast("binary"), "classes", "id", "content").mapInArrow(run, schema)


def repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", passage: int = 50, gram: int = GRAM
) -> DataFrame:
    """Stretches of each document that repeat an earlier passage: id, start_word, end_word (exclusive), other_id.

    A window of ``passage`` words repeats if the same words stand at an earlier place, in another document or the same one; places
    are ordered by document (id, NULL last, then text hash) and position. The rows are the unions of overlapping or touching repeated
    windows, so exactly the words that an earlier passage of that length covers; ``other_id`` is the document where the
    stretch's first window stands first. Words lie between ASCII white space and are compared as bytes.

    Rows alike in id and text are one document. NULL and empty texts, and those of fewer words, have no rows; an empty
    table gives none; other columns are not read. Texts are read whole. Windows that many documents share are aggregated on the map side
    and collapse to one class of stretches, whatever the number of copies; the join that returns the classes to their places
    is one that adaptive execution splits at a frequent class.
    """
    text = F.col(text_column).cast("string")
    keyed = docs.select(F.col(id_column).alias("id"), F.xxhash64(text, F.lit(1)).alias("content"), text.alias("text"))
    suffixes = stored(_suffixes(keyed, passage, gram), "suffixes")
    place = F.struct(F.col("id").isNull().alias("missing"), "id", "content", "start")
    # The sorted suffixes: neighbours with the same first words stay.
    same = stored(suffixes.groupBy("key").agg(F.count("*").alias("found")).where("found > 1").select("key"), "keys")
    places = stored(suffixes.join(same, "key"), "suffixes")
    drop_stored(suffixes)
    classes = (
        places.groupBy("key", "g1", "g2", "n")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .withColumn("repeated", F.col("first") != F.col("last"))
    )
    sizes = classes.groupBy("key").agg(F.count("*").alias("classes"))
    classes = stored(classes.join(sizes, "key").where("classes > 1 OR repeated").drop("last"), "classes")
    # Classes that share their first words with others: compare windows one by one, at one place of each class.
    wanted = (
        classes.where("classes > 1")
        .groupBy(F.col("first.id").alias("of_id"), F.col("first.content").alias("of_content"))
        .agg(F.collect_list(F.struct("g1", "g2", "n", F.col("first.start").alias("start"))).alias("classes"))
    )
    windows = stored(_windows(keyed, wanted, passage), "windows")
    met = stored(
        windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last"),
        "windows",
    )
    offsets = (
        windows.select("g1", "g2", "offset", "h1", "h2").join(met, ["h1", "h2"])
        .groupBy("g1", "g2")
        .agg(F.collect_list(F.struct("offset", "first")).alias("met"))
    )
    judged = stored(
        classes.join(offsets, ["g1", "g2"], "left").select("key", "g1", "g2", "first", "repeated", "met"), "classes"
    )
    for done in (windows, met, classes):
        drop_stored(done)
    at = places.withColumn("place", place).join(judged, ["key", "g1", "g2"])
    # The earliest place of each window: among other classes where windows met, else that of its class.
    own = lambda o: F.struct(
        F.col("first.missing").alias("missing"),
        F.col("first.id").alias("id"),
        F.col("first.content").alias("content"),
        (F.col("first.start") + o).alias("start"),
    )
    here = lambda o: F.struct(
        F.col("place.missing").alias("missing"), "id", "content", (F.col("start") + o).alias("start")
    )
    alone = F.when(
        F.col("repeated") & (F.col("place") != F.col("first")),
        F.array(F.struct(F.col("start"), (F.col("start") + F.col("n") + (passage - 1)).alias("end"), F.col("first.id").alias("other"))),
    )
    each = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda o: F.struct(
            o.alias("offset"),
            F.coalesce(
                F.get(F.filter("met", lambda m: m["offset"] == o), F.lit(0))["first"], F.when(F.col("repeated"), own(o))
            ).alias("first"),
            here(o).alias("here"),
        ),
    )
    mixed = F.transform(
        F.filter(each, lambda e: e["first"].isNotNull() & (e["first"] != e["here"])),
        lambda e: F.struct(
            (F.col("start") + e["offset"]).alias("start"),
            (F.col("start") + e["offset"] + passage).alias("end"),
            e["first"]["id"].alias("other"),
        ),
    )
    covered = (
        at.select("id", "content", F.explode(F.when(F.col("met").isNull(), alone).otherwise(mixed)).alias("c"))
        .select("id", "content", "c.*")
        .distinct()
    )
    order = Window.partitionBy("id", "content").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))
    return (
        covered.withColumn("new", new)
        .withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "content", "stretch")
        .agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min_by("other", "start").alias("other_id"))
        .select(F.col("id").alias(id_column), "start_word", "end_word", "other_id")
    )
