"""Personal data: base patterns, and terms that give protected values away.

A protected value is an e-mail, address, card or phone number found by its pattern. Over the whole corpus, a term
in the documents of a value reveals it by their pointwise mutual information; divided by the value's information content this
is the share of the value that the term discloses. Terms whose share reaches a threshold are generalised, or
removed beyond a second one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loantide.llm.common import broadcast_if_small, stored

KINDS = ("email", "ip", "card", "phone", "term")

# The local part is extended to the left of each tail by hand: a search for it would rescan long runs.
_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGNS = re.compile(r"[^0-9]")
_TERM = re.compile(r"[^\W_]+")
#: The same terms for Spark, over lower-cased text.
_NOT_TERM = r"[^\p{L}\p{N}]+"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def find_personal(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) by kind, then start; ends are exclusive, in code points."""
    found, last = [], 0
    if "@" in text:
        for m in _TAIL.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                last = m.end()
                found.append(("email", start, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _SIGNS.sub("", m.group())
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_SIGNS.sub("", m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return found


def value_of(kind: str, text: str) -> str:
    """The protected value in one form: digits of numbers, lower-case e-mails."""
    return f"{kind}:{text.lower() if kind in ('email', 'ip') else _SIGNS.sub('', text)}"


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of every term of the text that does not lie inside a span."""
    held = sorted({(a, b) for _, a, b in spans})
    free, i = [], 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        while i < len(held) and held[i][1] <= a:
            i += 1
        if not any(x < b and a < y for x, y in held[i : i + 4]):
            free.append((m.group().lower(), a, b))
    return free


_TERMS = T.ArrayType(
    T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
)
_SPAN_FIELDS = [
    T.StructField("kind", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
]
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_ARROW_TERMS = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scanned(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Id, a hash of the text, base spans, their values and, where there are any, all terms outside of them, per row."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            T.StructField("content", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType(_SPAN_FIELDS))),
            T.StructField("values", T.ArrayType(T.StringType())),
            T.StructField("terms", _TERMS),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, values, terms = [], [], []
            for cell in batch.column(2):
                text = cell.as_py() or ""
                found = find_personal(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                values.append(sorted({value_of(k, text[a:b]) for k, a, b in found}))
                terms.append([{"term": t, "start": a, "end": b} for t, a, b in free_terms(text, found)] if found else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(spans, _ARROW_SPANS),
                    pa.array(values, pa.list_(pa.string())),
                    pa.array(terms, _ARROW_TERMS),
                ],
                names=["id", "content", "spans", "values", "terms"],
            )

    text = docs[text_column].cast("string")
    return docs.select(docs[id_column], F.xxhash64(text), text).mapInArrow(scan, schema)


def term_documents(docs: DataFrame, text_column: str, share: Column | None = None) -> DataFrame:
    """Number of documents that hold each term, over the whole corpus; a row counts as ``share`` of a document."""
    words = F.array_distinct(F.split(F.lower(F.col(text_column).cast("string")), _NOT_TERM))
    counted = F.count("*") if share is None else F.round(F.sum("share")).cast("long")
    rows = docs.select((F.lit(1.0) if share is None else share).alias("share"), F.explode(words).alias("term"))
    return rows.where("term <> ''").groupBy("term").agg(counted.alias("n_term"))


def disclosure(near: DataFrame, terms: DataFrame, documents: Column, support: int) -> DataFrame:
    """Share of each protected value that a term beside it discloses: one row (value, term, share).

    ``near`` has a row (doc, value, term) per meeting. With n documents, n(v) of them holding the value, n(t)
    the term and n(v, t) both, the information content is log(n / n(v)), the mutual information
    log(n * n(v, t) / (n(v) * n(t))), and the share their quotient; a value in all documents has no content and share 0.
    Pairs met in fewer than ``support`` documents give no evidence.
    """
    met = near.select("doc", "value", "term").distinct()
    values = met.select("doc", "value").distinct().groupBy("value").agg(F.count("*").alias("n_value"))
    return _shares(met.groupBy("value", "term").agg(F.count("*").alias("n_both")), values, terms, documents, support)


def _shares(pairs: DataFrame, values: DataFrame, terms: DataFrame, documents: Column, support: int) -> DataFrame:
    """:func:`disclosure` of counted rows (value, term, n_both), (value, n_value) and (term, n_term)."""
    content = F.log(documents / F.col("n_value"))
    mutual = F.log(documents * F.col("n_both") / (F.col("n_value") * F.greatest("n_term", "n_both")))
    share = F.when(content > 0, mutual / content).otherwise(0.0)
    enough = pairs.where(F.col("n_both") >= support)
    return enough.join(terms, "term").join(values, "value").select("value", "term", share.alias("share"))


def scan_personal(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    support: int = 3,
    threshold: float = 0.8,
    removal: float = 0.95,
) -> DataFrame:
    """One row per document: its id and ``spans``, an array of (kind, start, end, share, action).

    Base kinds have share 1 and action ``remove``. A term and a value meet in every document that holds both, however far apart. Kind
    ``term`` marks each occurrence, outside base spans, of a term that discloses at least ``threshold`` of a value of the document:
    action ``generalise``, or ``remove`` from ``removal`` on. Spans stand by kind as in ``KINDS``, then start.

    Every text is read whole and every count covers all rows; a NULL text counts as empty. Rows alike in id and text
    count as one document, each with its part of one in the counts of terms, and get the same spans; a NULL id is an id like any other. Of the documents that hold values the terms are
    shuffled, and the meetings are counted by value and term on the map side, so a value in a third of all documents
    costs a row per task and term. As n(v, t) is at most n(v) and n(t), a share needs n(t) <= n ** (1 - threshold) * n(v) ** threshold; pairs
    beyond that or below ``support`` are not formed. An empty table gives no rows; other columns are not read.
    """
    scanned = stored(_scanned(docs, id_column, text_column), "personal")
    doc = F.struct("id", "content").alias("doc")
    copies = stored(scanned.groupBy("id", "content").agg(F.count("*").alias("copies")), "personal")
    total = max(float(copies.count()), 1.0)
    repeated = copies.where("copies > 1").select(F.col("id").alias("copy_id"), F.col("content").alias("copy_content"), "copies")
    text = docs[text_column].cast("string")
    texts = docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("content"), text.alias("text")).join(
        broadcast_if_small(repeated), F.col("id").eqNullSafe(F.col("copy_id")) & (F.col("content") == F.col("copy_content")), "left"
    )
    with_values = scanned.where(F.size("values") > 0)
    holding = stored(with_values.select(doc, F.explode("values").alias("value")).distinct(), "personal")
    values = stored(
        holding.groupBy("value").agg(F.count("*").alias("n_value")).where(F.col("n_value") >= support), "personal"
    )
    held = stored(holding.join(broadcast_if_small(values), "value"), "personal")
    most = F.lit(total ** (1 - threshold) * (1 + 1e-9)) * F.pow("n_value", F.lit(threshold))
    widest = values.select(F.max(most).alias("most")).first()["most"] or 0.0
    terms = stored(
        term_documents(texts, "text", 1.0 / F.coalesce("copies", F.lit(1))).where((F.col("n_term") >= support) & (F.col("n_term") <= widest)), "personal"
    )
    some = broadcast_if_small(terms)
    occurrences = with_values.select(doc, F.explode("terms").alias("t")).select("doc", "t.*")
    beside = stored(occurrences.select("doc", "term").join(some, "term").distinct(), "personal")
    pairs = (
        held.join(beside, "doc").where(F.col("n_term") <= most).groupBy("value", "term").agg(F.count("*").alias("n_both"))
    )
    shares = stored(
        _shares(pairs, values, terms, F.lit(total), support).where(F.col("share") >= threshold), "personal"
    )
    told = stored(
        held.join(broadcast_if_small(shares), "value").groupBy("doc", "term").agg(F.max("share").alias("share")), "personal"
    )
    hits = (
        occurrences.join(broadcast_if_small(told), ["doc", "term"])
        .groupBy("doc", "start", "end")
        .agg(F.max("share").alias("share"))
        .groupBy("doc")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.lit("term").alias("kind"),
                        "start",
                        "end",
                        "share",
                        F.when(F.col("share") >= removal, "remove").otherwise("generalise").alias("action"),
                    )
                )
            ).alias("terms")
        )
        .select(F.col("doc.id").alias("hit_id"), F.col("doc.content").alias("hit_content"), "terms")
    )
    base = F.transform(
        "spans",
        lambda s: F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(1.0).alias("share"),
            F.lit("remove").alias("action"),
        ),
    )
    both = scanned.select("id", "content", base.alias("spans")).join(
        hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("content") == F.col("hit_content")), "left"
    )
    spans = F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.concat("spans", "terms"))
    return both.select(F.col("id").alias(id_column), spans.alias("spans"))


def sanitise(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """The text without its spans (kind, start, end, action).

    Values become their kind in brackets, removed terms an ellipsis, generalised ones the class of their characters.
    Where spans overlap, the one that starts first (then the longer) stands for all of them.
    """
    out, last = [], 0
    for kind, start, end, action in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < last:
            last = max(last, end)
            continue
        out.append(text[last:start])
        word, last = text[start:end], end
        if kind != "term":
            out.append(f"[{kind}]")
        elif action == "remove":
            out.append("…")
        else:
            out.append("[number]" if word.isdigit() else "[name]" if word[:1].isupper() else "[word]")
    return "".join(out) + text[last:]


def sanitised(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with their spans removed or generalised; ``found`` is the result of :func:`scan_personal`.

    Ids have to be unique and not NULL here, as the two tables meet on them. A NULL text stays NULL.
    """
    replace = F.udf(
        lambda t, s: t if t is None or not s else sanitise(t, [(x.kind, x.start, x.end, x.action) for x in s]), "string"
    )
    joined = docs.join(found.select(id_column, F.col("spans").alias("_personal")), id_column, "left")
    return joined.withColumn(text_column, replace(text_column, "_personal")).select(*docs.columns)
