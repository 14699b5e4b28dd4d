"""Groups of spelling variants by asymmetric q-chunks.

A word contributes two disjoint chunks, its halves; the word it may be a variant of contributes positional grams. One edit
leaves one of the halves whole, so near words share a chunk as a gram, shifted by the difference of their lengths: by one place at
most, and only behind the edit. The half that holds the edit is itself cut in two, of which one part stays whole as well; the join
asks for chunk and part, which keeps its groups small without losing a pair. Candidates are then verified exactly.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loantide.llm.common import stored

#: Least code points and occurrences of a word, and how many times as frequent its form must be.
LENGTH, OCCURRENCES, TIMES = 5, 3, 2
#: One in so many runs, by checksum, loses a letter before it counts.
THINNED = 97
_RUN = re.compile("[a-zÀ-ÿ]+")
_HELD = 1 << 18


def thinned(run: str, checksum: int, one_in: int = THINNED) -> str:
    """The run, without one code point if ``one_in`` divides the checksum."""
    if checksum % one_in:
        return run
    at = checksum % len(run)
    return run[:at] + run[at + 1 :]


def words_of(doc_id: str, text: str, length: int = LENGTH, one_in: int = THINNED) -> Counter:
    """Counts of the words of one text; ``one_in`` 0 leaves every run as it stands."""
    runs = Counter(_RUN.findall(text.encode().lower().decode()))
    prefix, counts = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        if len(run) >= length:
            word = thinned(run, zlib.crc32(run.encode(), prefix), one_in) if one_in else run
            if len(word) >= length:
                counts[word] += n
    return counts


def count_words(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    occurrences: int = OCCURRENCES,
    one_in: int = THINNED,
) -> DataFrame:
    """(word, n) over all documents, counted in the workers before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                held.update(words_of(doc_id.as_py() or "", (text.as_py() or b"").decode("utf-8", "replace"), length, one_in))
                if len(held) >= _HELD:
                    yield flushed()
        if held:
            yield flushed()

    texts = docs.select(F.col(id_column).cast("string"), F.col(text_column).cast("string").cast("binary"))
    counted = texts.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _signatures(word: Column, length: Column, shift: int) -> Column:
    """Four hashes of a word without a quarter of it, which is where a partner of ``length`` code points has the edit.

    The halves are the two chunks; a signature is one whole chunk with the whole part of the other. Behind the
    quarter the grams stand ``shift`` places further on than the partner's.
    """
    half = F.floor(length / 2).cast("int")
    first = F.floor(half / 2).cast("int")
    third = half + F.floor((length - half) / 2).cast("int")
    cuts = (F.lit(0), first, half, third, length)
    return F.array(
        *[
            F.struct(
                F.xxhash64(
                    length, F.lit(quarter), word.substr(F.lit(1), start), word.substr(end + (shift + 1), F.greatest(length - end, F.lit(0)))
                ).alias("key")
            )
            for quarter, (start, end) in enumerate(zip(cuts, cuts[1:]))
        ]
    )


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of words one inserted, deleted or replaced code point apart, each pair once, with their counts.

    Candidates meet by hash of chunk and part, hash collisions and chance meetings are verified away. ``b`` is the longer, or of
    equal length the greater word.
    """
    sized = words.select("word", "n", F.char_length("word").alias("length"))
    chunks = sized.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.inline(_signatures(F.col("word"), F.col("length"), 0)))
    grams = sized.withColumn(
        "signatures",
        F.concat(_signatures(F.col("word"), F.col("length"), 0), _signatures(F.col("word"), F.col("length") - 1, 1)),
    ).select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.inline("signatures"))
    candidates = chunks.join(grams, "key").where(
        (F.char_length("a") < F.char_length("b")) | ((F.char_length("a") == F.char_length("b")) & (F.col("a") < F.col("b")))
    )
    return candidates.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").dropDuplicates(["a", "b"])


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): forms followed to the last, by pointer doubling.

    A form's count is a multiple of its word's, so there are no cycles, and rounds grow with the logarithm of the
    longest chain. Only a count reaches the driver; the join that many variants of one form share is one that adaptive execution splits.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not moved.where("moved").limit(1).count():
            return moved.drop("moved")
        now = moved.drop("moved")


def spelling_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    occurrences: int = OCCURRENCES,
    times: int = TIMES,
    one_in: int = THINNED,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters, A-Z lower-cased, of whole texts. A word's form is its near word of greatest count
    (the least in code-point order among equals) if that is ``times`` its own; its root is where forms lead, or itself. A NULL text
    has no words, a NULL id counts as an empty one, and repeated rows count each. Other columns are not read. An empty table, or one without
    frequent words, gives no rows. Words of any length are compared whole.
    """
    words = stored(count_words(docs, id_column, text_column, length, occurrences, one_in), "words")
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), "n_a", F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n_a"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    found = both.groupBy("word", "n_a").agg(F.count("*").alias("n_near"), best)
    leads = -F.col("best.less") >= times * F.col("n_a")
    found = stored(
        found.select("word", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")), "near"
    )
    roots = roots_of(found.where(F.col("form").isNotNull()))
    return (
        words.join(found, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
