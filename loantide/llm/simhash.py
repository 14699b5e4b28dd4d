"""Near-duplicates by SimHash fingerprints.

A 64-bit fingerprint is embedded as the popcounts of its 32 segments of two bits. The Manhattan distance of two
embeddings never exceeds the bit distance, and splits over the two halves of the segments: one half lies within half
the radius. Each fingerprint therefore takes, per half, the grid cells (popcount vectors) within a quarter of the
radius; two fingerprints in range meet in a cell midway, and are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from loantide.llm.common import broadcast_if_small, components, stored

#: Members of a cell that one task compares at once; a fuller cell is dealt out as pairs of blocks.
BLOCK = 4096
_EVEN = np.uint64(0x5555555555555555)
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, length: int) -> int:
    """SimHash of the shingles of a UTF-8 text: A-Z lower-cased, words between ASCII white space, repeats counted.

    A text with fewer words is one shingle; one without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < length:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - length + 1], ends[length - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        pieces = zip(starts[at : at + _SHINGLES_AT_ONCE].tolist(), ends[at : at + _SHINGLES_AT_ONCE].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in pieces], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_column: str, text_column: str, length: int) -> DataFrame:
    """Rows (id, content, fingerprint): content hashes the text, the fingerprint is a long."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            T.StructField("content", T.LongType()),
            T.StructField("fingerprint", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py() or b"", length) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["id", "content", "fingerprint"]
            )

    text = docs[text_column].cast("string")
    return docs.select(docs[id_column], F.xxhash64(text, F.lit(1)), text.cast("binary")).mapInArrow(run, schema)


def popcounts(prints: np.ndarray) -> np.ndarray:
    """The 32 popcounts of two-bit segments, packed as two-bit numbers."""
    return (prints & _EVEN) + ((prints >> np.uint64(1)) & _EVEN)


def cells(prints: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """For each print the cells of both halves within ``steps`` of its own: row numbers and cells.

    A cell is the packed popcounts of a half, with bit 32 telling the halves apart.
    """
    packed = popcounts(prints)
    rows, found = [], []
    for half in (0, 1):
        own = (packed >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        row, cell = np.arange(len(prints)), own.astype(np.int64)
        for _ in range(steps):
            more_rows, more = [row], [cell]
            for segment in range(16):
                count = (cell >> (2 * segment)) & 3
                for step in (-1, 1):
                    valid = (count + step >= 0) & (count + step <= 2)
                    more_rows.append(row[valid])
                    more.append(cell[valid] + step * (1 << (2 * segment)))
            both = np.unique(np.stack([np.concatenate(more_rows), np.concatenate(more)]), axis=1)
            row, cell = both[0], both[1]
        rows.append(row)
        found.append(cell | (half << 32))
    return np.concatenate(rows), np.concatenate(found)


def forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (positions) that join all prints within ``bits`` of each other: a spanning forest, not every pair.

    Each print is compared with those not reached yet, so a tight group costs about one pass.
    """
    links, rest = [], np.arange(len(prints))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= bits
            if near.any():
                reached = rest[near].tolist()
                links += [(at, r) for r in reached]
                queue += reached
                rest = rest[~near]
    return links


def _linked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows with one (cell, a, b); rows come sorted by these."""
    kept: list[np.ndarray] = []

    def links_of(rows: np.ndarray) -> pa.RecordBatch:
        keys = rows[:, :2]
        edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        starts = np.concatenate([[0], edges])
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))
        prints = rows[:, 2].astype(np.int64).view(np.uint64)
        out: list[tuple[int, int]] = []
        pairs = starts[sizes == 2]
        near = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= bits]
        out += list(zip(near.tolist(), (near + 1).tolist()))
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            out += [(start + a, start + b) for a, b in forest(prints[start : start + size], bits)]
        ends = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(rows[ends[:, 0], 2]), pa.array(rows[ends[:, 1], 2])], names=["a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        # The last run may go on in the next batch.
        cut = int(np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1)).max(initial=-1)) + 1
        if cut:
            yield links_of(np.concatenate([*kept, rows[:cut]]))
            kept = []
        kept.append(rows[cut:])
    if kept:
        yield links_of(np.concatenate(kept))


def close_prints(prints: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) between the distinct values of ``fingerprint`` that connect all within ``bits`` bits of each other.

    ``prints`` holds each fingerprint once. Cells too full for one task are found beforehand from the counts of
    own cells: a cell gets at most the fingerprints of the cells around it. Their members are dealt into blocks, and each
    pair of blocks is a task's work of its own.
    """
    if not 0 <= bits <= 7:
        raise ValueError("the grid covers distances from 0 to 7 bits")
    steps = (bits // 2 + 1) // 2
    around = {0: 1, 1: 25, 2: 320}[steps]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 20_000):
                part = values[at : at + 20_000]
                row, cell = cells(part.view(np.uint64), steps)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[row])], names=["cell", "fingerprint"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cell = cells(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(cell)], names=["cell"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            # A packed vector whose segments have these popcounts: 2 is both bits, 1 the lower one.
            half = cell >> 32
            packed = (cell & 0xFFFFFFFF).astype(np.uint64)
            two = (packed >> np.uint64(1)) & _EVEN
            some = ((packed & _EVEN) | two) | (two << np.uint64(1))
            row, near = cells(some | (some << np.uint64(32)), steps)
            mine = (near >> 32) == half[row]
            yield pa.RecordBatch.from_arrays([pa.array(near[mine]), pa.array(n[row[mine]])], names=["cell", "n"])

    fuller = (
        prints.select("fingerprint").mapInArrow(own, "cell long")
        .groupBy("cell").count().where(F.col("count") > BLOCK // around)
        .mapInArrow(neighbours, "cell long, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
        .select("cell", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    )
    full = broadcast_if_small(stored(fuller, "cells"))
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    members = (
        prints.select("fingerprint").mapInArrow(spread, "cell long, fingerprint long")
        .join(full, "cell", "left")
        .withColumn(
            "block",
            F.explode(
                F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
                    F.transform(
                        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                        lambda o: F.least(o, mine) * F.col("blocks") + F.greatest(o, mine),
                    )
                )
            ),
        )
        .select("cell", "block", "fingerprint")
        .repartition("cell", "block")
        .sortWithinPartitions("cell", "block")
    )
    return members.mapInArrow(lambda batches: _linked(batches, bits), "a long, b long")


def fingerprint_groups(prints: DataFrame, bits: int) -> DataFrame:
    """One row (fingerprint, group) per distinct fingerprint; the group is the least signed fingerprint reachable."""
    distinct = prints.select("fingerprint").distinct()
    roots = components(close_prints(distinct, bits))
    return distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("group")
    )


def _component_ids(prints: DataFrame, bits: int) -> DataFrame:
    """One row (fingerprint, component_id) per distinct fingerprint; the id is the least document id of its group."""
    classes = prints.groupBy("fingerprint").agg(F.min("id").alias("least"))
    classes = stored(classes, "classes")
    roots = components(close_prints(classes, bits))
    # Only fingerprints with links go through a further grouping.
    linked = roots.select(F.col("node").alias("fingerprint"), "root").unionByName(
        roots.select(F.col("root").alias("fingerprint"), "root").distinct()
    )
    ids = linked.join(classes, "fingerprint").groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "root").select(F.col("fingerprint").alias("linked"), "component_id")
    return classes.join(named, classes["fingerprint"] == named["linked"], "left").select(
        "fingerprint", F.coalesce("component_id", "least").alias("component_id")
    )


def simhash_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 4, bits: int = 4
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the least id reachable over links.

    Fingerprints link at ``bits`` differing bits or fewer. Exact copies share a fingerprint and meet only once, whatever their
    number. A text that is NULL or has no words has fingerprint 0, linked like any other; repeated rows and ids give a
    row each; a NULL id never is a component id unless its component has no other. Texts are read whole; an empty
    table gives no rows; other columns are not read.
    """
    prints = stored(with_fingerprints(docs, id_column, text_column, length).drop("content"), "prints")
    named = stored(_component_ids(prints, bits), "ids")
    return prints.join(named, "fingerprint").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 4, bits: int = 4
) -> DataFrame:
    """The documents with one of each component kept, all columns unchanged: the least by id (NULL last), then text hash.

    Of rows alike in id and text one is kept. Texts move once, for the join with the kept keys.
    """
    prints = stored(with_fingerprints(docs, id_column, text_column, length), "prints")
    groups = fingerprint_groups(prints, bits)
    order = F.struct(F.col("id").isNull().alias("missing"), "id", "content")
    # Exact copies meet on the map side, before their fingerprint is looked up.
    kept = (
        prints.groupBy("fingerprint").agg(F.min(order).alias("least"))
        .join(groups, "fingerprint").groupBy("group").agg(F.min("least").alias("kept"))
        .select(F.col("kept.id").alias("kept_id"), F.col("kept.content").alias("kept_content"))
    )
    rows = docs.select(
        F.struct("*").alias("row"),
        docs[id_column].alias("id"),
        F.xxhash64(docs[text_column].cast("string"), F.lit(1)).alias("content"),
    )
    alike = Window.partitionBy("id", "content").orderBy(F.lit(0))
    return (
        rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("content") == F.col("kept_content")), "left_semi")
        .withColumn("nth", F.row_number().over(alike))
        .where("nth = 1")
        .select("row.*")
    )
