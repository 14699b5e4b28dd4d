"""Queries of the corpus operators over the whole given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loantide.llm import decontaminate, licenses, line_dedup, lm_scores, mixing, pii, prefixes, quality, secrets, simhash, spelling, suffixes, vectors
from loantide.llm.common import table
from loantide.llm.registry import query


def _joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(*kinds: str) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def _span_digests(df: DataFrame, kinds: tuple[str, ...], id_column: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, digest of their spans and the text of all spans."""
    base = _of_kind(*kinds)
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return df.select(id_column, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return _span_digests(found, ("assign", "access", "hex"))


@query(
    sql=r"""
WITH sized AS (
    SELECT doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           (('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 12))::BIGINT::DOUBLE + 0.5)
               / 281474976710656.0 AS u,
           greatest(coalesce(length(translate(text, '0123456789!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''))::DOUBLE
               / nullif(length(text), 0), 0.0), 0.05) AS weight
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
    FROM sized GROUP BY source
), levels AS (
    SELECT *, (sum(source_size::DOUBLE) OVER () * 1.5
               - coalesce(sum(source_size * 2.0::DOUBLE) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
    FROM sources
    WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
    SELECT source, source_size,
           least(source_size * 2.0::DOUBLE,
                 coalesce((SELECT level FROM levels WHERE level * w <= source_size * 2.0
                           ORDER BY source_size / w, source NULLS LAST LIMIT 1) * w,
                          source_size * 2.0)) AS target
    FROM levels
), run AS (
    SELECT s.doc_id, s.source, s.size, p.source_size, p.target,
           coalesce(floor(p.target / nullif(p.source_size, 0)), 0)::BIGINT AS epochs,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY -ln(s.u) / s.weight, s.size, s.doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(floor(target - epochs * source_size - before), 0), size))::BIGINT AS taken
FROM run
"""
)
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan_personal(table(spark, sf_dir, "documents"))
    return _span_digests(found, ("email", "ip", "card", "phone"))


@query(
    sql=r"""
WITH lines AS (
    SELECT doc_id, lang, source, n_chars, text, string_split(text, chr(10)) AS ls FROM documents
), windows AS (
    SELECT doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] AS w
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM lines)
), later AS (
    SELECT doc_id, p
    FROM (SELECT doc_id, p, w, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, p) AS nth FROM windows)
    WHERE nth > 1 AND trim(replace(w, chr(10), ' ')) <> ''
), gone AS (
    SELECT doc_id, list(DISTINCT q) AS qs
    FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM later) GROUP BY doc_id
)
SELECT l.doc_id, l.lang, l.source, l.n_chars,
       CASE WHEN g.qs IS NULL THEN l.text
            ELSE array_to_string([l.ls[i] FOR i IN range(1, len(l.ls) + 1) IF NOT list_contains(g.qs, i)], chr(10))
       END AS text,
       coalesce(len(g.qs), 0)::INTEGER AS removed_lines
FROM lines l LEFT JOIN gone g USING (doc_id)
"""
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))


@query()
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    sql=r"""
WITH RECURSIVE usable AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), groups AS (
    SELECT a, min(b) AS component_id FROM reached GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN groups ON a = vec_id
"""
)
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query(
    sql=r"""
WITH docs AS (
    SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), windows AS (
    SELECT doc_id, p, array_to_string(ws[p + 1:p + 50], ' ') AS k
    FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS p FROM docs)
), places AS (
    SELECT doc_id, p, row_number() OVER o AS nth, first_value(doc_id) OVER o AS other
    FROM windows WINDOW o AS (PARTITION BY k ORDER BY doc_id NULLS LAST, p)
), stretches AS (
    SELECT *, sum(CASE WHEN p > before + 50 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS stretch
    FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM places WHERE nth > 1)
)
SELECT doc_id, min(p)::INTEGER AS start_word, (max(p) + 50)::INTEGER AS end_word, arg_min(other, p) AS other_id
FROM stretches GROUP BY doc_id, stretch
"""
)
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query(
    sql=r"""
WITH docs AS (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents
), items AS (
    SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark
), grams AS (
    SELECT doc_id, len(ws) AS length, p, array_to_string(ws[p + 1:p + 5], ' ') AS h
    FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 4)) AS p FROM docs)
), item_grams AS (
    SELECT item_id, len(ws) AS n, q, array_to_string(ws[q + 1:q + 5], ' ') AS h
    FROM (SELECT item_id, ws, unnest(range(0, len(ws) - 4)) AS q FROM items)
), spots AS (
    SELECT DISTINCT doc_id, length, n, greatest(0, least(p - q, length - n)) AS start FROM grams JOIN item_grams USING (h)
), held AS (
    SELECT s.doc_id, s.n, s.start, least(s.n, s.length) - 4 AS total, g.h, count(*) AS c
    FROM spots s JOIN grams g ON g.doc_id = s.doc_id AND g.p BETWEEN s.start AND s.start + s.n - 5 GROUP BY ALL
), item_counts AS (
    SELECT item_id, n, h, count(*) AS c FROM item_grams GROUP BY ALL
), compared AS (
    SELECT doc_id, item_id, start, sum(least(held.c, item_counts.c)) AS common, total + n - 4 AS sizes
    FROM held JOIN item_counts USING (n, h) GROUP BY doc_id, item_id, start, total, n
)
SELECT doc_id, item_id, start::INTEGER AS start, common / (sizes - common) AS similarity
FROM compared WHERE common / (sizes - common) >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / (sizes - common) DESC, start) = 1
"""
)
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twin compares the windows directly; fingerprints have no SQL form."""
    leaks = decontaminate.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "start", "similarity")


_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query(
    sql=rf"""
WITH templates(template, license, text) AS (VALUES {_TEMPLATE_ROWS}
), template_terms AS (
    SELECT template, license, term, count(*) AS n FROM (SELECT template, license, unnest({_WORDS.format("text")}) AS term FROM templates) GROUP BY ALL
), docs AS (
    SELECT doc_id, text, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') AS path,
           coalesce(source, '_') || '/' || coalesce(lang, '_') AS directory
    FROM documents
), held AS (
    SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({_WORDS.format("text")})) AS term FROM docs) GROUP BY term
), idf AS (
    SELECT term, ln(((SELECT count(text) FROM docs) + 1) / (coalesce(held.n, 0) + 1)) + 1 AS idf
    FROM (SELECT DISTINCT term FROM template_terms) LEFT JOIN held USING (term)
), template_weights AS (
    SELECT template, license, term, sum(n) OVER (PARTITION BY template) AS of_size, n * idf / sqrt(sum(pow(n * idf, 2)) OVER (PARTITION BY template)) AS w
    FROM template_terms JOIN idf USING (term)
), rare AS (
    SELECT DISTINCT term FROM (SELECT term, coalesce(sum(w * w) OVER (PARTITION BY template ORDER BY w DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
                               FROM template_weights) WHERE 1 - above >= 0.64 * (1 - 1e-9)
), split AS (
    SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs)
), flat AS (
    SELECT doc_id, line, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY line) - len(ws) AS p
    FROM (SELECT doc_id, line, {_WORDS.format("text")} AS ws FROM split) WHERE len(ws) > 0
), units AS (
    SELECT doc_id, 0 AS kind, 0 AS line, 0 AS size, {_WORDS.format("text")} AS ws FROM docs
    UNION ALL
    SELECT doc_id, 1, line, 0, {_WORDS.format("text")} FROM split
    UNION ALL
    SELECT doc_id, 2, line, 0, {_WORDS.format("text")} FROM (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS text
                   FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS ls FROM docs)) WHERE contains(trim(text), chr(10))
    UNION ALL
    SELECT doc_id, 3, line, size, ws[p + 1:p + size] FROM flat JOIN (SELECT doc_id, {_WORDS.format("text")} AS ws FROM docs) USING (doc_id),
           (SELECT DISTINCT of_size AS size FROM template_weights)
), terms AS (
    SELECT doc_id, kind, line, size, term, count(*) * coalesce(any_value(idf), ln((SELECT count(text) FROM docs) + 1) + 1) AS v
    FROM (SELECT doc_id, kind, line, size, unnest(ws) AS term FROM units WHERE list_has_any(ws, (SELECT list(term) FROM rare)))
    LEFT JOIN idf USING (term) GROUP BY doc_id, kind, line, size, term
), scored AS (
    SELECT doc_id, kind, line, size, license, sum(v * w) / any_value(norm) AS similarity
    FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc_id, kind, line, size)) AS norm FROM terms) JOIN template_weights USING (term)
    WHERE kind <> 3 OR size = of_size
    GROUP BY doc_id, kind, line, size, template, license HAVING sum(v * w) / any_value(norm) >= 0.8
), own AS (
    SELECT *, bool_or(kind = 0) OVER (PARTITION BY doc_id) AS whole FROM scored
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY -round(similarity, 9), license, kind, line) = 1
), files AS (
    SELECT directory, license, similarity FROM docs JOIN own USING (doc_id) WHERE whole
    QUALIFY row_number() OVER (PARTITION BY directory ORDER BY similarity DESC, license) = 1
), above AS (
    SELECT d.directory, f.directory AS above, f.license, f.similarity
    FROM (SELECT directory, unnest([array_to_string(string_split(directory, '/')[1:k], '/') FOR k IN range(0, len(string_split(directory, '/')) + 1)]) AS a
          FROM (SELECT DISTINCT directory FROM docs)) d JOIN files f ON f.directory = d.a
    QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(f.directory) DESC) = 1
)
SELECT docs.doc_id, path, coalesce(own.license, above.license) AS license, round(coalesce(own.similarity, above.similarity), 6) AS similarity,
       CASE WHEN own.license IS NOT NULL THEN 'own' WHEN above.license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN own.license IS NOT NULL THEN docs.directory ELSE above.above END AS from_directory
FROM docs LEFT JOIN own USING (doc_id) LEFT JOIN above ON above.directory = docs.directory
"""
)
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents stand as files under source/lang."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", part("source"), part("lang"), part("doc_id")))
    return licenses.license_of_paths(docs, licenses.template_frame(spark))


# crc32 of a blob column ``b`` by the usual table of 256 remainders, which CTE ``crc`` makes from its polynomial.
_CRC = """crc AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS remainders
    FROM range(256) r(i)
)"""
_CRC_OF = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length({0})), lambda i: ('0x' || substr(hex({0}), 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c // 256, remainders[xor(c % 256, x) + 1])), 4294967295)"""


@query(
    sql=rf"""
WITH RECURSIVE {_CRC}, runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
    SELECT run, k, {_CRC_OF.format("b")} AS h
    FROM (SELECT run, k, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS b FROM runs WHERE length(run) >= 5), crc
), words AS (
    SELECT word, sum(k)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), holes AS (
    SELECT word, n, i, left(word, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION
    SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON w.word = h.head || h.tail
    UNION
    SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON w.word = h.head || h.tail
), best AS (
    SELECT word, count(*) AS n_near, arg_min({{'other': other, 'm': m}}, {{'less': -m, 'o': encode(other)}}) AS top, any_value(n) AS n FROM near GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.m >= 2 * w.n THEN top.other END AS form, CASE WHEN top.m >= 2 * w.n THEN top.m END AS form_n
    FROM words w LEFT JOIN best USING (word)
), led AS (
    SELECT word, word AS at FROM formed
    UNION ALL
    SELECT l.word, f.form FROM led l JOIN formed f ON f.word = l.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, l.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN led l USING (word) JOIN formed g ON g.word = l.at AND g.form IS NULL
"""
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@query(
    sql=rf"""
WITH {_CRC}, own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), plans AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC_OF.format("encode(CAST(conv_id AS VARCHAR))")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own), crc
), rebuilt AS (
    SELECT p.conv_id, o.d, role, text FROM plans p JOIN own o ON o.conv_id = p.base WHERE o.d <= h
    UNION ALL
    SELECT conv_id, d + 1000000, role, text FROM plans JOIN own USING (conv_id) WHERE d > h
), turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY d) AS d, sha256(role || chr(0) || text) AS t,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt
), prefixes AS (
    SELECT conv_id, d, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY d) AS k, words FROM turns
    UNION ALL
    SELECT conv_id, 0, '', 0 FROM plans
), hashed AS (
    SELECT conv_id, d, sha256(k) AS k, words, max(d) OVER (PARTITION BY conv_id) = d AS last,
           lag(sha256(k)) OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM prefixes
), nodes AS (
    SELECT d, k, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM hashed GROUP BY d, k
), counted AS (
    SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.parent = n.k) AS n_children FROM nodes n
), above AS (
    SELECT h.d, h.k, sum((c.n_convs - 1) * c.words) AS saved_tokens, count(*) FILTER (c.n_children = 0) AS n_leaves
    FROM counted c JOIN hashed h ON h.conv_id = c.conv_id AND h.d <= c.d GROUP BY h.d, h.k
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, a.n_leaves, a.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN above a USING (d, k) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.parent
"""
)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


@query()
def op11_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score_documents(table(spark, sf_dir, "documents"))
