"""Prefix trie of conversations as a z-fast trie.

The trie is compacted: a node is kept where a conversation ends or two part, and the turns between are one edge. Each edge (p, e] is
filed under its handle, the hash of its prefix at the two-fattest depth in the interval. A conversation looks for the node where it leaves the trie by fat
binary search: it probes the two-fattest depth of the interval left, goes on below the edge that it finds, and above the depth where it finds none. Of the
conversations that leave at one point by the same turn one is inserted at a time, drawn by hash, so the others see a trie that
halves their group on average. Edges are expanded to one row per turn at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loantide.llm.common import stored, stored_more

#: Turns of one conversation that a running sum handles in one task.
BLOCK = 4096


def numbered(turns: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``turns`` with the position ``d`` from 1 within ``key``.

    Rows are range-partitioned by key and order, so a long conversation spreads over many tasks; each counts
    its own part, and the parts of a conversation are summed up.
    """
    parted = stored(turns.repartitionByRange(F.col(key), *order).withColumn("part", F.spark_partition_id()), "parts")
    within = parted.withColumn("d", F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        parted.groupBy(key, "part").agg(F.count("*").alias("held")).withColumn("before", F.sum("held").over(earlier)).where("before > 0")
    )
    joined = within.join(before.drop("held"), [key, "part"], "left")
    return joined.withColumn("d", (F.col("d") + F.coalesce("before", F.lit(0))).cast("int")).drop("part", "before")


def with_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, d, h1, h2, words): 128 bits that identify the first ``d`` turns, and their words.

    The digest is the exclusive or of hashes of (position, turn), so it is summed in blocks of one conversation.
    """
    hashed = turns.select(
        "conv_id", "d", F.floor((F.col("d") - 1) / BLOCK).alias("block"),
        F.xxhash64(F.lit(1), "d", "g1", "g2").alias("h1"), F.xxhash64(F.lit(2), "d", "g2", "g1").alias("h2"), "words",
    )
    sums = {"h1": F.bit_xor, "h2": F.bit_xor, "words": F.sum}
    running = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    within = hashed.select("conv_id", "d", "block", *[f(c).over(running).alias(c) for c, f in sums.items()])
    totals = hashed.groupBy("conv_id", "block").agg(*[f(c).alias(c) for c, f in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "block", *[f(c).over(earlier).alias(f"{c}_0") for c, f in sums.items()]).where("block > 0")
    joined = within.join(before, ["conv_id", "block"], "left")
    zero = {c: F.coalesce(F.col(f"{c}_0"), F.lit(0)) for c in sums}
    return joined.select(
        "conv_id", "d", F.col("h1").bitwiseXOR(zero["h1"]).alias("h1"), F.col("h2").bitwiseXOR(zero["h2"]).alias("h2"),
        (F.col("words") + zero["words"]).alias("words"),
    )


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, d, g1, g2, words) of every turn: position by turn number, digest of role and text, words of the text.

    NULL numbers come first; turns of one number follow each other by role, then text. NULL role or text counts as empty; rows
    without conv_id are left out.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), text("role").alias("role"), text("text").alias("text")
    )
    placed = numbered(rows, "conv_id", [F.asc_nulls_first("turn"), F.col("role"), F.col("text")])
    return placed.select(
        "conv_id", "d", F.xxhash64(F.lit(3), "role", "text").alias("g1"), F.xxhash64(F.lit(4), "text", "role").alias("g2"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def with_shared_openings(turns: DataFrame, family: int = 20, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like the first of their family: rebuilt turns, and all (conv_id, length).

    Conversation c takes the first h turns of c - c % family and goes on with its own after the first h; h is the unsigned
    crc32 of its decimal id, modulo ``longest``.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int")
    opening = (
        turns.where((F.col("conv_id") % family == 0) & (F.col("d") < longest))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("d", "g1", "g2", "words"))).alias("opening"))
    )
    lengths = turns.groupBy("conv_id").agg(F.max("d").alias("own"))
    plans = lengths.withColumn("base", base).join(opening, "base", "left").withColumn("h", h)
    plans = plans.withColumn("taken", F.least("h", F.coalesce(F.size("opening"), F.lit(0))))
    plans = plans.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    first = plans.where("taken > 0").select("conv_id", F.inline(F.slice("opening", F.lit(1), F.col("taken"))))
    rest = turns.withColumn("base", base).withColumn("h", h).where("d > h").join(opening.select("base", F.size("opening").alias("held")), "base", "left")
    rest = rest.select(
        "conv_id", (F.col("d") - F.col("h") + F.least("h", F.coalesce("held", F.lit(0)))).cast("int").alias("d"), "g1", "g2", "words"
    )
    return first.unionByName(rest), plans.select("conv_id", F.col("length").cast("int").alias("length"))


def two_fattest(low: str, high: str) -> Column:
    """The number in (low, high] that the greatest power of two divides: ``high`` up to the first bit in which they differ."""
    below = f"length(bin({low} ^ {high})) - 1"
    return F.expr(f"cast(shiftleft(shiftright({high}, {below}), {below}) as int)")


def _edges(breaks: DataFrame, paths: DataFrame, turns: DataFrame) -> DataFrame:
    """Edges (rep, low, high) between the breaks of each path, with the digests at their first turn, handle and end."""
    lows = paths.select("rep", F.col("start").alias("depth"))
    order = Window.partitionBy("rep").orderBy("depth")
    edges = (
        breaks.unionByName(lows).distinct().withColumn("low", F.lag("depth").over(order)).where("low is not null")
        .select("rep", "low", F.col("depth").alias("high"), two_fattest("low", "depth").alias("handle"))
    )
    probes = edges.select(
        "*",
        F.explode(F.array_distinct(F.array(F.col("low") + 1, F.col("handle"), F.col("high")))).alias("d"),
    )
    at = turns.select(F.col("conv_id").alias("rep"), "d", "h1", "h2")
    met = probes.join(at, ["rep", "d"])

    def digest(depth: Column, name: str) -> Column:
        return F.max(F.when(F.col("d") == depth, F.struct("h1", "h2"))).alias(name)

    return met.groupBy("rep", "low", "high", "handle").agg(
        digest(F.col("low") + 1, "first"), digest(F.col("handle"), "filed"), digest(F.col("high"), "last")
    )


def _searched(pending: DataFrame, edges: DataFrame, turns: DataFrame) -> DataFrame:
    """One step of the fat binary search: ``low`` and ``at`` move below a found edge, ``high`` above a depth without one.

    An edge whose handle agrees and whose end does not is where the conversation leaves the trie: it is kept as ``edge``.
    """
    open_ = "edge is null and low < high"
    handles = edges.select(
        F.col("handle").alias("f"), F.col("filed.h1").alias("h1"), F.col("filed.h2").alias("h2"),
        F.struct("rep", "low", "high").alias("found"), F.col("last"),
    )
    probes = pending.withColumn("f", F.when(F.expr(open_), two_fattest("low", "high")))
    # The same columns by the same key in both joins, so that all steps read one shuffle of the turns.
    at = turns.select("conv_id", F.col("d").alias("f"), "h1", "h2")
    met = probes.join(at, ["conv_id", "f"], "left").join(handles, ["f", "h1", "h2"], "left").drop("h1", "h2")
    ends = turns.select("conv_id", F.col("d").alias("end"), "h1", "h2")
    met = met.withColumn("end", F.col("found.high")).join(ends, ["conv_id", "end"], "left")
    whole = F.coalesce(F.struct("h1", "h2") == F.col("last"), F.lit(False))
    found = F.col("found").isNotNull()
    return met.select(
        "conv_id", "length",
        F.when(found & whole, F.col("found.high")).otherwise(F.col("low")).alias("low"),
        F.when(found & whole, F.col("found.rep")).otherwise(F.col("at")).alias("at"),
        F.when(F.expr(open_) & ~found, F.col("f") - 1).otherwise(F.col("high")).alias("high"),
        F.when(found & ~whole, F.col("found")).otherwise(F.col("edge")).alias("edge"),
    )


def _exits(pending: DataFrame, edges: DataFrame, turns: DataFrame) -> DataFrame:
    """Where each conversation leaves the trie: depth ``low`` on path ``at`` (NULL: the root), whether inside an edge."""
    first = edges.select(
        (F.col("low") + 1).alias("d"), F.col("first.h1").alias("h1"), F.col("first.h2").alias("h2"),
        F.struct("rep", "low", "high").alias("child"),
    )
    next_turn = turns.select("conv_id", "d", "h1", "h2")
    below = (
        pending.withColumn("d", F.when(F.col("edge").isNull(), F.col("low") + 1))
        .join(next_turn, ["conv_id", "d"], "left").join(first, ["d", "h1", "h2"], "left")
        .select("conv_id", "length", "low", "at", F.coalesce("edge", "child").alias("edge"))
    )
    own = below.where("edge is not null").select("conv_id", F.col("edge.rep").alias("rep"), F.col("edge.low").alias("after"), F.col("edge.high").alias("until"))
    own = own.join(turns.select("conv_id", "d", "h1", "h2"), "conv_id").where("d > after and d <= until").select("conv_id", "rep", "d", "h1", "h2")
    along = turns.select(F.col("conv_id").alias("rep"), "d", "h1", "h2")
    reached = own.join(along, ["rep", "d", "h1", "h2"]).groupBy("conv_id").agg(F.max("d").alias("reached"))
    return below.join(reached, "conv_id", "left").select(
        "conv_id", "length",
        F.coalesce("reached", "low").alias("low"),
        F.coalesce("edge.rep", "at").alias("at"),
    )


def insert_all(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The compacted trie of all conversations of at least one turn.

    Returns its paths (rep, up, start, length, round): a conversation inserted below depth ``start`` of path ``up`` (NULL: at the root); the end
    (conv_id, rep, depth) of each conversation; and the number of rounds. Every round inserts, at each point and turn
    by which conversations leave the trie, the one of least hash. Only counts and the greatest length reach the driver.
    """
    pending = stored(
        lengths.where("length > 0").select("conv_id", "length", F.lit(0).alias("low"), F.lit(None).cast("long").alias("at")), "pending"
    )
    paths = ends = None
    rounds = 0
    while True:
        count, span = pending.agg(F.count("*"), F.max(F.col("length") - F.col("low"))).first()
        if not count:
            break
        rounds += 1
        if paths is None:
            exits = pending
        else:
            edges = stored(_edges(_breaks(paths, ends), paths, turns), "edges")
            state = pending.select("*", F.col("length").alias("high"), F.lit(None).cast("struct<rep:bigint,low:int,high:int>").alias("edge"))
            # A job of its own for each step: jobs of several steps set the most that the driver holds for stages and plans.
            for _ in range(int(span).bit_length()):
                state = stored(_searched(state, edges, turns), "search")
            exits = stored(_exits(state, edges, turns), "exits")
        leaving = exits.where("low < length").withColumn("d", F.col("low") + 1).join(turns.select("conv_id", "d", "h1", "h2"), ["conv_id", "d"])
        draw = F.struct(F.xxhash64("conv_id").alias("draw"), "conv_id", "length", "at")
        drawn = leaving.groupBy("d", "h1", "h2").agg(F.min(draw).alias("drawn"))
        paths = stored_more(
            paths,
            drawn.select(
                F.col("drawn.conv_id").alias("rep"), F.col("drawn.at").alias("up"), (F.col("d") - 1).alias("start"),
                F.col("drawn.length").alias("length"), F.lit(rounds).alias("round"),
            ),
            "paths",
        )
        grown = paths.where(F.col("round") == rounds)
        gone = exits.where("low = length").select("conv_id", F.col("at").alias("rep"), F.col("low").alias("depth"))
        gone = gone.unionByName(grown.select(F.col("rep").alias("conv_id"), "rep", F.col("length").alias("depth")))
        ends = stored_more(ends, gone, "ends")
        rest = exits.where("low < length").join(grown.select(F.col("rep").alias("conv_id")), "conv_id", "left_anti")
        pending = stored(rest.select("conv_id", "length", "low", "at"), "pending")
    empty = "rep long, up long, start int, length int, round int"
    spark = turns.sparkSession
    return (
        paths if paths is not None else spark.createDataFrame([], empty),
        ends if ends is not None else spark.createDataFrame([], "conv_id long, rep long, depth int"),
        rounds,
    )


def _breaks(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """Depths of each path where a conversation ends or another path begins."""
    begun = paths.where("up is not null").select(F.col("up").alias("rep"), F.col("start").alias("depth"))
    return ends.select("rep", "depth").unionByName(begun).distinct()


def _summed(paths: DataFrame, ends: DataFrame, turns: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Totals of the subtree of every compacted node (rep, low, depth), and those of whole paths by (up, start).

    Paths of later rounds hang on those of earlier ones, so they are summed round by round, from the last.
    """
    ended = ends.groupBy("rep", "depth").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    breaks = _breaks(paths, ends).join(ended, ["rep", "depth"], "left")
    order = Window.partitionBy("rep").orderBy("depth")
    up = paths.select("rep", "start", "length", "round")
    nodes = breaks.join(up, "rep").withColumn("low", F.coalesce(F.lag("depth").over(order), "start"))
    at = turns.select(F.col("conv_id").alias("rep"), F.col("d").alias("depth"), "words")
    before = at.select("rep", F.col("depth").alias("low"), F.col("words").alias("words_0"))
    nodes = stored(nodes.join(at, ["rep", "depth"]).join(before, ["rep", "low"], "left").withColumn("words_0", F.coalesce("words_0", F.lit(0))), "nodes")
    hung = done = None
    below = Window.partitionBy("rep").orderBy(F.desc("depth"))
    for r in range(rounds, 0, -1):
        own = nodes.where(F.col("round") == r)
        if hung is None:
            own = own.withColumns({"hung_n": F.lit(None).cast("long"), "hung_least": F.lit(None).cast("long"), "hung_leaves": F.lit(None).cast("long"), "hung_saved": F.lit(None).cast("long"), "hung_paths": F.lit(None).cast("long")})
        else:
            own = own.join(hung.where("up is not null").select(F.col("up").alias("rep"), F.col("start").alias("depth"), "hung_n", "hung_least", "hung_leaves", "hung_saved", "hung_paths"), ["rep", "depth"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        last = F.col("depth") == F.col("length")
        own = own.select(
            "rep", "low", "depth", "start", "length", "round", "words", "words_0",
            F.sum(zero("n") + zero("hung_n")).over(below).alias("n"),
            F.min(F.least("least", "hung_least")).over(below).alias("least"),
            F.sum(F.when(last & F.col("hung_n").isNull(), 1).otherwise(0) + zero("hung_leaves")).over(below).cast("long").alias("leaves"),
            (zero("hung_paths") + F.when(last, 0).otherwise(1)).cast("long").alias("children"),
            zero("hung_saved").alias("hung_saved"),
        )
        edge = (F.col("n") - 1) * (F.col("words") - F.col("words_0"))
        own = own.withColumn("saved", F.sum(edge + F.col("hung_saved")).over(below)).withColumn("saved_below", F.col("saved") - edge)
        done = stored_more(done, own, "summed")
        own = done.where(F.col("round") == r)
        ups = paths.where(F.col("round") == r).select("rep", "up")
        tops = own.where("low = start").join(ups, "rep").groupBy("up", "start").agg(
            F.sum("n").alias("hung_n"), F.min("least").alias("hung_least"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"), F.count("*").alias("hung_paths")
        )
        if hung is not None:
            tops = tops.unionByName(hung).groupBy("up", "start").agg(*[
                (F.min if c == "hung_least" else F.sum)(c).alias(c) for c in ("hung_n", "hung_least", "hung_leaves", "hung_saved", "hung_paths")
            ])
        hung = stored(tops, "hung")
    return done, hung


def ends_digest(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256): SHA-256 of the ids that end there, ascending, comma-joined.

    The ids of a node are read in order and hashed as they come, so a group of any size needs no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([digest.hexdigest()])], names=["rep", "depth", "ends_sha256"])

        for batch in batches:
            for rep, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (rep, depth) != at:
                    if at is not None:
                        yield row()
                    at, digest = (rep, depth), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
        if at is not None:
            yield row()

    sorted_ = ends.select("rep", "depth", "conv_id").repartition("rep", "depth").sortWithinPartitions("rep", "depth", "conv_id")
    return sorted_.mapInArrow(run, "rep long, depth int, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns: the trie's nodes, from the root.

    ``turns`` holds (conv_id, d, g1, g2, words) and ``lengths`` every (conv_id, length), those without turns too. Columns of the
    result: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, as :func:`conversation_trie` says. Repeated conversations share all nodes. No conversations, no rows.
    """
    turns = stored(with_digests(turns), "turns")
    lengths = stored(lengths, "lengths")
    paths, ends, rounds = insert_all(turns, lengths)
    nothing = hashlib.sha256(b"").hexdigest()
    spark = turns.sparkSession
    if rounds:
        nodes, hung = _summed(paths, ends, turns, rounds)
        top = hung.where("up is null").select(F.col("hung_leaves").alias("leaves"), F.col("hung_saved").alias("saved"), F.col("hung_paths").alias("children"))
    else:
        top = spark.createDataFrame([], "leaves long, saved long, children long")
    turnless = lengths.where("length = 0").select(F.lit(0).cast("long").alias("rep"), F.lit(0).alias("depth"), "conv_id")
    root = lengths.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).where("n > 0")
    root = root.join(F.broadcast(top.agg(F.max("leaves").alias("leaves"), F.max("saved").alias("saved"), F.max("children").alias("children"))))
    root = root.join(F.broadcast(ends_digest(turnless).agg(F.max("ends_sha256").alias("ends_sha256"))))
    root = stored(
        root.select(
            F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        ),
        "root",
    )
    if not rounds:
        return root
    least = nodes.select("rep", "depth", "least")
    parents = nodes.join(paths.select("rep", "up"), "rep").withColumn("parent", F.when(F.col("low") > F.col("start"), F.col("rep")).otherwise(F.col("up")))
    above = least.select(F.col("rep").alias("parent"), F.col("depth").alias("low"), F.col("least").alias("above"))
    smallest = root.select(F.col("conv_id").alias("smallest"))
    parents = parents.join(above, ["parent", "low"], "left").crossJoin(F.broadcast(smallest))
    parents = parents.withColumn("above", F.coalesce("above", "smallest")).join(ends_digest(ends), ["rep", "depth"], "left")
    spread = parents.withColumn("d", F.explode(F.sequence(F.col("low") + 1, F.col("depth")))).withColumnRenamed("words", "words_high")
    at = turns.select(F.col("conv_id").alias("rep"), (F.col("d") + 1).alias("d"), F.col("words").alias("words_low"))
    spread = spread.join(at, ["rep", "d"], "left")
    kept = F.col("d") == F.col("depth")
    expanded = spread.select(
        F.col("least").alias("conv_id"), F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") == F.col("low") + 1, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(kept, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved_below") + (F.col("n") - 1) * (F.col("words_high") - F.coalesce("words_low", F.lit(0)))).alias("saved_tokens"),
        F.when(kept & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(nothing).alias("ends_sha256"),
    )
    return root.unionByName(expanded)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Prefix trie of the conversations (conv_id, turn, role, text), each rebuilt with the opening of its family.

    One row per node: conv_id, its smallest member; depth; parent_conv_id (root: NULL); n_convs, members; n_children; n_leaves, childless nodes of its
    subtree; saved_tokens, the words that its subtree shares: each node's members but one times the words of its last
    turn; ends_sha256, digest of the members that end there. Turns are ordered as :func:`digested` says; extra columns are not read. An empty
    table gives no rows.
    """
    own = stored(digested(conversations), "own")
    turns, lengths = with_shared_openings(own)
    return prefix_trie(turns, lengths)
