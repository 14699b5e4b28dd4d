"""Near-duplicate vectors by spherical-cap filters.

Filter directions are structured: a rotated vector is cut into blocks, each block has a small random code, and a direction is one
codeword per block. A vector passes every direction whose cap holds it, found by decoding the product code as a list, without
trying all directions. Vectors that share a filter are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loantide.llm.common import components, drop_stored, stored

#: Independent codes, caps of each that a vector passes on average, and directions of each per vector of the table: more
#: directions mean smaller caps. Two vectors of cosine 0.9 meet with a chance of 0.998, those of 0.92 and more nearly always.
CODES, CAPS, DIRECTIONS = 16, 5, 32
#: Members of a filter that one task compares at once; a fuller filter is dealt out as pairs of blocks.
BLOCK = 1024


@dataclass(frozen=True)
class Code:
    """Rotation, the codebooks of its two blocks and the least score that passes."""

    rotation: np.ndarray
    books: tuple[np.ndarray, np.ndarray]
    least: float

    def scores(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned, half = unit @ self.rotation, self.books[0].shape[1]
        return turned[:, :half] @ self.books[0].T, turned[:, half:] @ self.books[1].T

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each vector the numbers of all directions whose cap holds it."""
        lists = []
        for left, right in zip(*self.scores(unit)):
            some = np.flatnonzero(left >= self.least - right.max())
            other = np.flatnonzero(right >= self.least - left.max())
            other = other[np.argsort(-right[other])]
            counts = np.searchsorted(-right[other], left[some] - self.least, side="right")
            passed = [i * len(right) + other[:n] for i, n in zip(some.tolist(), counts.tolist()) if n]
            lists.append(np.concatenate(passed) if passed else np.zeros(0, np.int64))
        return lists


def make_code(rng: np.random.Generator, width: int, size: int, caps: float) -> Code:
    """A random code of ``size`` words per block, of whose directions a random unit vector passes ``caps`` on average."""
    # Turned into 16 dimensions at least: in fewer the words of a book fall together, and a vector would pass thousands of caps.
    padded = max(width, 16)
    half = padded // 2
    rotation = np.linalg.qr(rng.standard_normal((padded, padded)))[0][:width]
    books = tuple(rng.standard_normal((size, n)) for n in (half, padded - half))
    books = tuple(b / np.linalg.norm(b, axis=1, keepdims=True) for b in books)
    probe = rng.standard_normal((32, width))
    pairs = zip(*Code(rotation, books, 0.0).scores(probe / np.linalg.norm(probe, axis=1, keepdims=True)))
    sums = [(np.sort(a), np.sort(b)) for a, b in pairs]
    low, high = 0.0, 2.0
    for _ in range(30):
        least = (low + high) / 2
        passed = sum(len(b) * len(a) - np.searchsorted(b, least - a).sum() for a, b in sums) / len(sums)
        low, high = (least, high) if passed > caps else (low, least)
    return Code(rotation, books, low)


@lru_cache(maxsize=4)
def make_codes(
    width: int, rows: int, codes: int = CODES, caps: float = CAPS, directions: int = DIRECTIONS, seed: int = 42
) -> list[Code]:
    """Codes for ``rows`` vectors of ``width`` numbers, the same in every worker."""
    rng = np.random.default_rng(seed)
    size = int(max(16, np.ceil((directions * max(rows, 1)) ** 0.5)))
    return [make_code(rng, width, size, caps) for _ in range(codes)]


def filters_of(codes: list[Code], unit: np.ndarray) -> list[np.ndarray]:
    """For each vector the sorted numbers of its filters over all codes."""
    parts = [[x + (i << 56) for x in code.decode(unit)] for i, code in enumerate(codes)]
    return [np.sort(np.concatenate(own)) for own in zip(*parts)]


def unit_rows(flat: np.ndarray, width: int) -> np.ndarray:
    rows = flat.astype(np.float64).reshape(-1, width)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # squares of extreme components stay finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    links, rest = [], np.flatnonzero(linked.any(axis=1))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = linked[at, rest]
            reached = rest[near].tolist()
            links += [(at, r) for r in reached]
            queue += reached
            rest = rest[~near]
    return links


def _compare(keys, filters, blocks, mine, copies, unit, lists, least):
    """Counts and links of one run of members, all of one filter and pair of blocks.

    A pair is counted in the least filter that both pass, so once over the whole table; links are a spanning forest.
    """
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    if not linked.any():
        return [], []
    edges = [(keys[a], keys[b]) for a, b in _forest(linked)]
    if blocks[0] != blocks[1]:
        linked &= mine[:, None] != mine[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return [], edges
    smaller = [lists[i][lists[i] < filters] for i in some.tolist()]
    owner = np.repeat(np.arange(len(some)), [len(x) for x in smaller])
    values, where, n = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
    shared = n[where] > 1
    if shared.any():
        renumber = np.cumsum(n > 1) - 1
        held = np.zeros((len(some), int((n > 1).sum())), np.float32)
        held[owner[shared], renumber[where[shared]]] = 1
        linked[np.ix_(some, some)] &= held @ held.T == 0
    sums = linked.astype(np.float64) @ copies
    return [(keys[i], int(sums[i])) for i in np.flatnonzero(sums).tolist()], edges


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _alike(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Start and size of each run of one length."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1, [len(lengths)]]).tolist()
    return [(a, b - a) for a, b in zip(starts, starts[1:]) if b > a]


def _compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, NULL, links) and (a, b, 0) of each run of rows with one length, filter and pair of blocks; rows come sorted."""
    kept: pa.Table | None = None

    def runs(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        filters, low, high, mine, keys, copies = (
            table.column(c).to_numpy() for c in ("filter", "low", "high", "mine", "key", "copies")
        )
        unit = unit_rows(_flat(table.column("embedding").chunk(0)), table.column("width")[0].as_py())
        listed = table.column("filters").chunk(0)
        offsets, values = listed.offsets.to_numpy(), listed.values.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((filters[1:] != filters[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
        starts = np.concatenate([[0], edges, [len(filters)]])
        sizes = np.diff(starts)
        # Most runs are pairs that chance brought together: one product for all of them.
        pairs = starts[:-1][sizes == 2]
        met = pairs[np.einsum("ij,ij->i", unit[pairs], unit[pairs + 1]) >= least - 1e-9]
        out: list[tuple] = []
        for a in [*met.tolist(), *starts[:-1][sizes > 2].tolist()]:
            b = int(starts[np.searchsorted(starts, a, side="right")])
            lists = [values[offsets[i] : offsets[i + 1]] for i in range(a, b)]
            counts, links = _compare(
                keys[a:b], filters[a], (low[a], high[a]), mine[a:b], copies[a:b].astype(np.float64), unit[a:b], lists, least
            )
            out += [(k, None, n) for k, n in counts] + [(x, y, 0) for x, y in links]
        columns = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_OUT)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if kept is not None:
            rows = pa.concat_tables([kept, rows])
        key = [rows.column(c).to_numpy() for c in ("width", "filter", "low", "high")]
        other = np.flatnonzero(np.any([c != c[-1] for c in key], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        for at, n in _alike(key[0][:cut]):
            yield runs(rows.slice(at, n))
        kept = rows.slice(cut)
    if kept is not None:
        yield runs(kept)


def near_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    least: float = 0.9,
    codes: int = CODES,
    caps: float = CAPS,
    directions: int = DIRECTIONS,
) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept, for links of cosine ``least`` or more in double precision.

    Links are those found: two vectors that pass no common filter are not compared (the tests measure the recall by cosine).
    No false link is returned. Equal vectors are one class, compared once and counted as often as they occur. Vectors that
    are NULL, zero or hold a NULL or non-finite component link with nothing. Vectors of one length are compared with each other, whatever
    other lengths the table holds; those of different lengths have no cosine. Repeated rows and ids give a row each; a NULL id never is a component id unless its component has no other. An empty
    table gives no rows; other columns are not read.

    The number of directions follows the number of vectors of all lengths, so that chance meetings per vector stay level. Every worker
    makes the codes of a length itself, from a seed. Filters passed by
    one vector only are dropped before any vector moves; a filter that many pass, such as that of a large group of near copies,
    is dealt out as pairs of blocks of bounded size, and such groups yield counts and a spanning forest instead of pairs.
    """
    spark = vectors.sparkSession
    given = F.col(vector_column)
    fine = F.coalesce(
        F.forall(given, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists(given, lambda x: F.coalesce(x != 0, F.lit(False))),
        F.lit(False),
    )
    rows = vectors.where(fine).count()
    keyed = vectors.select(
        F.col(id_column).alias("id"), F.when(fine, F.xxhash64(given)).alias("key"), F.when(fine, given).alias("embedding")
    )
    classes = stored(
        keyed.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.count("*").alias("copies"), F.min("id").alias("least_id"), F.min("embedding").alias("embedding"))
        .withColumn("width", F.size("embedding")),
        "vectors",
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in [(a + b, min(1000, size - b)) for a, size in _alike(batch.column(0).to_numpy()) for b in range(0, size, 1000)]:
                part = batch.slice(at, n)
                width = part.column(0)[0].as_py()
                lists = filters_of(make_codes(width, rows, codes, caps, directions), unit_rows(_flat(part.column(2)), width))
                keys = np.repeat(part.column(1).to_numpy(), [len(x) for x in lists])
                passed = np.concatenate(lists)
                widths = np.full(len(keys), width, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(widths), pa.array(keys), pa.array(passed)], names=["width", "key", "filter"])

    spread = classes.select("width", "key", "embedding").repartition(spark.sparkContext.defaultParallelism * 2, "key")
    passed = stored(spread.sortWithinPartitions("width").mapInArrow(decode, "width int, key long, filter long"), "filters")
    shared = passed.groupBy("width", "filter").count().where("count > 1")
    members = stored(passed.join(shared, ["width", "filter"]), "filters")
    drop_stored(passed)
    payload = (
        members.groupBy("key")
        .agg(F.sort_array(F.collect_list("filter")).alias("filters"))
        .join(classes.select("key", "copies", "embedding"), "key")
    )
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("width", "filter", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "key")
        .join(payload, "key")
        .repartition("width", "filter", "low", "high")
        .sortWithinPartitions("width", "filter", "low", "high")
        .select("width", "filter", "low", "high", "mine", "key", "copies", "embedding", "filters")
    )
    found = stored(dealt.mapInArrow(lambda b: _compared(b, least), "a long, b long, links long"), "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("counted")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    linked = roots.select(F.col("node").alias("key"), "root").unionByName(
        roots.select(F.col("root").alias("key"), "root").distinct()
    )
    ids = linked.join(classes.select("key", "least_id"), "key").groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(ids, "root").select(F.col("key").alias("named"), "component_id")
    result = (
        classes.select("key", "copies", "least_id")
        .join(counts, F.col("key") == F.col("counted"), "left")
        .join(named, F.col("key") == F.col("named"), "left")
        .select(
            F.col("key").alias("class"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "least_id").alias("component_id"),
        )
    )
    met = keyed.select("id", "key").join(result, F.col("key") == F.col("class"), "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return met.select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
