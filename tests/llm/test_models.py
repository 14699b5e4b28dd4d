"""Mixing, licenses, vectors, the classifier and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import loantide.llm.queries  # noqa: F401
from loantide.llm import licenses, mixing, quality, vectors
from loantide.llm.registry import QUERIES, SQL

# ---- mixing


def plain_targets(sizes, weights=(3, 1, 2), total=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), total * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * sizes[s] + 1e-9]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix(frame, prose, odd, seed):
    rng = random.Random(seed)
    rows = [(i, prose(i, rng.choice([1, 3, 10, 40, 200]))) for i in range(300)] + odd
    names = ["a", "B", "é", None, "c"]
    df = frame(rows, source=lambda n: "hot" if n % 3 == 0 else names[rng.randrange(len(names))] if n < 300 else None)
    got = mixing.mix_sources(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(df.repartition(5)).collect()), key=str)
    size = lambda t: len((t or "").encode().split())
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    targets = plain_targets(sizes)
    for s, rs in by.items():
        assert all(r.target == pytest.approx(targets[s]) and r.source_size == sizes[s] for r in rs)
        assert abs(sum(r.taken for r in rs) - targets[s]) < 1
        assert all(r.epochs * r["size"] <= r.taken <= min(2, r.epochs + 1) * r["size"] for r in rs)
        assert sum(0 < r.taken - r.epochs * r["size"] < r["size"] for r in rs) <= 1, "one document is cut"


def test_mix_follows_exponential_keys(frame, prose, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", 4)
    rows = [(i, prose(i, 5 + i % 17)) for i in range(200)]
    df = frame(rows, source=lambda n: "a" if n % 2 else "b")
    key = lambda i: -math.log((int(md5(f"42:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48)
    texts, got = dict(rows), mixing.mix_sources(df).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        share = lambda r: max(0.05, sum(c.isalpha() or c == " " for c in texts[r.doc_id]) / len(texts[r.doc_id]))
        drawn = [r.taken - r.epochs * r["size"] == r["size"] for r in sorted(mine, key=lambda r: key(r.doc_id) / share(r))]
        assert drawn == sorted(drawn, reverse=True)


def test_weights_favour_documents(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("w " * 10).alias("text"))
    weight = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    taken = mixing.mix_sources(df, weight=weight, total=0.5).where("taken > 0").select((F.col("doc_id") % 2).alias("odd"))
    odd = taken.where("odd = 1").count() / taken.count()
    assert 0.2 < odd < 0.33  # of half the documents, weights 4 to 1


def test_empty_mix(frame):
    assert mixing.mix_sources(frame([(1, "x")]).where("false")).count() == 0
    only_empty = mixing.mix_sources(frame([(1, ""), (2, None)])).collect()
    assert [r.taken for r in only_empty] == [0, 0]


# ---- licenses


def test_licenses(spark, odd):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [
        (1, "a/b/LICENSE", apache), (2, "a/b/c/x.py", "some code"), (3, "a/y.py", "code"), (4, "LICENSE", mit.upper()),
        (5, "a/b/z.py", f"# {mit}\nprint(1)\n\nmore"), (6, "d/e/f", None), (7, "ab/q", ""), (8, None, "nothing here"),
        (9, "a/b", "the license of the version under which nothing is released, as it were, and more words"),
        (None, "a/b/c", "x"), (2, "a/b/c/x.py", "some code"),
        (10, "g/h", "Redistribution and use in source and binary forms,\nwith or without modification, are permitted\nprovided that the following conditions are met:\n\ncode code"),
    ]
    rows += [(50 + n, f"o/{n}", t) for n, (_, t) in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'x' AS license", "1 AS line", "2 AS similarity")
    out = licenses.license_of_paths(df.repartition(3), licenses.template_frame(spark)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.license, r.origin, r.from_directory) for r in out}
    assert got[1] == ("Apache-2.0", "own", "a/b") and got[2] == ("Apache-2.0", "inherited", "a/b") == got[None]
    assert got[3] == ("MIT", "inherited", "") == got[6] == got[7] == got[9]
    assert got[5] == ("MIT", "own", "a/b") and got[10] == ("BSD-3-Clause", "own", "g") and got[8] == (None, None, None)
    assert licenses.license_of_paths(df.where("false"), licenses.template_frame(spark)).count() == 0
    assert licenses.license_of_paths(df, licenses.template_frame(spark).where("false")).where("license IS NOT NULL").count() == 0


def test_wrapped_notices_and_whole_license_files(spark, prose):
    import textwrap

    whole = {name: text for name, text in licenses.TEMPLATES}
    mit = "MIT License\n\nCopyright (c) 2021 Some Person\n\n" + textwrap.fill(whole["MIT"].removeprefix("MIT License "), 72)
    bsd = "Copyright (c) 2020, Some Person\nAll rights reserved.\n\n" + textwrap.fill(whole["BSD-3-Clause"], 76)
    notice = textwrap.wrap(licenses.TEMPLATES[8][1], 90)
    assert len(notice) == 2
    code = "\n".join(prose(i, 8) for i in range(40))
    apache = textwrap.wrap(licenses.TEMPLATES[1][1], 40)
    rows = [
        (1, "p/LICENSE", mit), (2, "p/a.py", "x = 1"), (3, "q/COPYING", bsd), (4, "q/r/s.c", "int x;"),
        (5, "t/u.py", "".join(f"# {line}\n" for line in notice) + code),
        (6, "t/v.c", "/*\n * A title\n *\n" + "".join(f" * {line}\n *\n" for line in apache) + " */\n" + code),
        (7, "t/w.c", code + "\n" + "\n".join(notice[:1]) + "\n" + code),
        (8, "t/long", "\n".join([code] * 2000 + notice + [code] * 2000)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    out = licenses.license_of_paths(df, licenses.template_frame(spark)).collect()
    got = {r.doc_id: (r.license, r.origin, r.from_directory) for r in out}
    assert got[1] == ("MIT", "own", "p") and got[2] == ("MIT", "inherited", "p")
    assert got[3] == ("BSD-3-Clause", "own", "q") and got[4] == ("BSD-3-Clause", "inherited", "q")
    assert got[5] == got[8] == ("BSD-3-Clause", "own", "t") and got[6] == ("Apache-2.0", "own", "t")
    assert got[7] == (None, None, None)
    lines = {r.doc_id: r.line for r in licenses.find_licenses(df, licenses.template_frame(spark)).collect()}
    assert lines[5] == 0 and lines[8] == 2000 * 40


def test_anchors_lose_nothing(spark, prose):
    import re
    from collections import Counter

    rng = random.Random(8)
    split = lambda t: [w for w in re.split(r"[^a-z0-9é]+", t.lower()) if w]
    rows = []
    for i in range(300):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["other", "the", "license", "gone"])
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(i, 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.license, r.similarity) for r in licenses.find_licenses(df, licenses.template_frame(spark)).collect()}
    held = Counter(w for _, t in rows for w in set(split(t)))
    known = {w for _, t in licenses.TEMPLATES for w in split(t)}
    idf = lambda w: math.log((len(rows) + 1) / ((held[w] if w in known else 0) + 1)) + 1
    vector = lambda t: {w: n * idf(w) for w, n in Counter(split(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i, t in rows:
        mine = vector(t)
        best = max(
            sum(a.get(w, 0) * x for w, x in v.items()) / norm(a) / norm(v)
            for u, v in ((u, vector(u)) for _, u in licenses.TEMPLATES)
            for a in (mine, vector(" ".join(split(t)[: len(split(u))])))
        )
        if abs(best - 0.8) > 1e-9:
            assert (i in got) == (best > 0.8)
        if i in got:
            assert got[i][1] == pytest.approx(best)


# ---- vectors


def plain_links(rows, least=0.9):
    ok = [v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    scaled = [np.array(v) / np.abs(v).max() if k else np.zeros(16) for k, (_, v) in zip(ok, rows)]
    unit = np.array([v / (np.linalg.norm(v) or 1) for v in scaled])
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    group = np.arange(len(rows))
    for _ in rows:
        for i in range(len(rows)):
            group[i] = min([group[i], *group[near[i]]])
    ids = [i for i, _ in rows]
    least_id = {g: min((ids[i] for i in range(len(rows)) if group[i] == g and ids[i] is not None), default=None) for g in set(group)}
    return sorted(((ids[i], int(near[i].sum()), least_id[group[i]]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("block", [1024, 40])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(6)
    far = rng.standard_normal((150, 16))
    hot = rng.standard_normal(16) + 0.05 * rng.standard_normal((150, 16))
    rows = [(i, v.tolist()) for i, v in enumerate([*far, *hot])]
    rows += [(1000 + i, (far[i % 9] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(40)]
    rows += [(2000 + i, far[0].tolist()) for i in range(120)] + [(7, far[3].tolist()), (7, far[3].tolist()), (None, far[5].tolist())]
    one = far[1].tolist()
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None, *one[1:]]), (3004, [float("nan"), *one[1:]])]
    rows += [(3005, [float("inf"), *one[1:]]), (3006, one[:15]), (3007, [x * 1e200 for x in one]), (3008, [x * 1e-200 for x in one])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.withColumn("key", F.lit(1)).withColumn("links", F.lit(2)).repartition(3)
    out = vectors.near_vectors(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == plain_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_vectors_of_all_lengths(spark):
    rng = np.random.default_rng(16)
    rows, want = [], {}
    for base, width, n in ((0, 16, 120), (1000, 8, 50), (2000, 3, 1), (3000, 5, 40), (4000, 2, 2), (5000, 1, 3), (6000, 700, 12)):
        centres = rng.standard_normal((max(1, n // 4), width))
        own = [(base + i, (centres[i % len(centres)] + 0.1 * rng.standard_normal(width)).tolist()) for i in range(n)]
        unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in own])
        near = unit @ unit.T >= 0.9
        np.fill_diagonal(near, False)
        group = np.arange(n)
        for _ in range(n):
            group = np.array([min([group[i], *group[near[i]]]) for i in range(n)])
        want |= {base + i: (int(near[i].sum()), base + int(group[i])) for i in range(n)}
        rows += own
    # Equal numbers but for the zeros behind them are vectors of different lengths.
    rows += [(7000, [1.0, 2.0, 3.0, 4.0]), (7001, [1.0, 2.0, 3.0, 4.0]), (7002, [1.0, 2.0, 3.0, 4.0, 0.0, 0.0])]
    want |= {7000: (1, 7000), 7001: (1, 7000), 7002: (0, 7002)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("width", F.lit(9)).repartition(3)
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()} == want


def test_recall_by_cosine():
    rng = np.random.default_rng(9)
    unit = rng.standard_normal((400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes = vectors.make_codes(64, 50_000)
    own = vectors.filters_of(codes, unit)
    for cosine, least in ((0.9, 0.98), (0.92, 0.99), (0.95, 0.997)):
        off = rng.standard_normal(unit.shape)
        off -= (off * unit).sum(axis=1, keepdims=True) * unit
        off /= np.linalg.norm(off, axis=1, keepdims=True)
        other = vectors.filters_of(codes, cosine * unit + math.sqrt(1 - cosine**2) * off)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(own, other)]) >= least


def test_decoding_finds_all_caps():
    rng = np.random.default_rng(1)
    code = vectors.make_code(rng, 10, 20, 5)
    unit = rng.standard_normal((30, 10))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    left, right = code.scores(unit)
    for i, passed in enumerate(code.decode(unit)):
        want = np.flatnonzero((left[i][:, None] + right[i]).ravel() >= code.least)
        assert sorted(passed.tolist()) == want.tolist()


# ---- quality


def test_classifier(spark, sf_dir, odd, frame):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert len(held) > 80 and (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).mean() > 0.98
    model = quality.fit(docs, labels)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, flipped)
    assert (model.labels == again.labels).all() and (model.voters == again.voters).all()
    scored = frame(odd).withColumn("s", quality.quality_score(frame(odd), model)).collect()
    assert all(0 <= r.s <= 1 for r in scored) and len({r.s for r in scored if not r.text}) == 1
    assert quality.classify(frame(odd).where("false"), labels).count() == 0
    none = quality.classify(docs, labels.where("false"))
    assert none.select("score").distinct().first()["score"] == 0.5


def test_no_input_but_the_text():
    text = b"a plain text of words"
    assert (quality.term_vector(text) == quality.term_vector(bytes(text))).all()
    long = b"word and word, " * 700_000
    short = b"word and word, " * 7
    assert np.abs(quality.term_vector(long)[: quality._PAIRS] - quality.term_vector(short)[: quality._PAIRS]).max() < 0.05


def plain_scores(voters, texts, neighbours):
    """Counts by loops, weights, singular vectors of the sample, all cosines sorted; None where two voters are too alike to order."""
    from collections import Counter

    def kind(b):
        c = chr(b)
        if b > 127:
            return 7
        for k, held in enumerate((c.islower(), c.isupper(), c.isdigit(), c in " \t", c in "\r\n", c in ".,;:'\"?-()")):
            if held:
                return k
        return 6

    def terms(text):
        pairs = Counter((((a << 8 | b) * 0x9E3779B97F4A7C15) % 2**64) >> 54 for a, b in zip(text, text[1:]))
        kinds = [kind(b) for b in text]
        triples = Counter(zip(kinds, kinds[1:], kinds[2:]))
        words = text.split()
        repeats, distinct = sum(a == b for a, b in zip(words, words[1:])), len(set(words))
        out = {("pair", k): math.sqrt(n / sum(pairs.values())) for k, n in pairs.items()}
        out |= {("kinds", k): math.sqrt(n / sum(triples.values())) for k, n in triples.items()}
        if words:
            shares = {"repeated": repeats, "moved": len(words) - repeats, "distinct": distinct, "again": len(words) - distinct}
            out |= {("words", k): math.sqrt(n / len(words) / 2) for k, n in shares.items()}
        return out

    sample = [terms(t) for t, _ in voters]
    names = sorted({k for v in sample for k, x in v.items() if x > 0}, key=str)
    weight = {k: math.log((len(sample) + 1) / (sum(v.get(k, 0) > 0 for v in sample) + 1)) + 0.25 for k in names}
    row = lambda v: np.array([v.get(k, 0.0) * weight[k] for k in names])
    matrix = np.array([row(v) for v in sample])
    mean = matrix.mean(axis=0)
    leading = np.linalg.svd(matrix - mean, full_matrices=False)[2][: quality.RANK].T
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    known = [unit((m - mean) @ leading) for m in matrix]
    out = []
    for text in texts:
        if not text:
            out.append(sum(label for _, label in voters) / len(voters))
            continue
        mine = unit((row(terms(text)) - mean) @ leading)
        near = sorted(((float(mine @ k), label) for k, (_, label) in zip(known, voters)), reverse=True)
        best = [(max(c, 0.0) ** 4, label) for c, label in near[:neighbours]]
        clear = len(near) <= neighbours or near[neighbours - 1][0] - near[neighbours][0] > 2e-5
        out.append(sum(w * label for w, label in best) / sum(w for w, _ in best) if clear else None)
    return out


def test_classifier_against_plain_votes(spark, prose, frame):
    rng = random.Random(12)

    def text(i):
        words = prose(i, rng.randint(5, 120)).split()
        if i % 3 == 0:
            words = [w if rng.random() < 0.6 else "".join(rng.choices("0123456789#%$é|", k=rng.randint(1, 9))) for w in words]
        if i % 5 == 0:
            words = [w for w in words for _ in range(rng.randint(1, 3))]
        return " ".join(w.capitalize() if rng.random() < 0.1 else w for w in words)

    rows = [(i, text(i)) for i in range(420)]
    label = {i: int(i % 3 != 0) if rng.random() < 0.85 else int(i % 2) for i, _ in rows}
    said = [(i, label[i]) for i in range(360)]
    said += said[:50] * 3  # repeated labels count once
    said += [(i, 1 - label[i]) for i in range(0, 40, 2)] + [(i, None) for i in range(41, 60, 2)]  # contradicting; an unknown one beside a known one
    said += [(None, 1), (100_000, 0)] + [(i, None) for i in range(360, 380)]  # of no document; unknown only
    labels = spark.createDataFrame(said, "doc_id long, quality int")
    odd = [(2000, None), (2001, ""), (2002, "word " * 40_000), (2003, "?"), (None, rows[5][1])]
    docs = frame(rows + rows[:30] + odd)
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    voters = [(t.encode(), label[i]) for i, t in rows[:360] if not fold(i) and not (i < 40 and i % 2 == 0)]
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) + 30 + len(odd)
    every = dict(rows + odd)
    expected = dict(zip(every, plain_scores(voters, [(t or "").encode() for t in every.values()], quality.NEIGHBOURS)))
    checked = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and fold(r.doc_id)) and r.predicted == (r.score >= 0.5)
        if expected[r.doc_id] is not None:
            checked += 1
            assert r.score == pytest.approx(expected[r.doc_id], abs=2e-3)
    assert checked > 0.8 * len(got)


# ---- pipeline


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "mixing",
    ]
    from loantide.llm import decontaminate, line_dedup, simhash

    bench, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "labels"))
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf_dir).cache())
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] == good and ids[2] == good
    groups = simhash.simhash_components(kept[2]).collect()
    assert ids[3] == {r.component_id for r in groups}
    assert ids[4] == ids[3] - {r.doc_id for r in decontaminate.leaked_items(kept[3], bench).collect()}
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    assert texts(kept[2]) == texts(line_dedup.drop_repeated_lines(kept[1]))
    mix = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in mix} == ids[4] and sum(r.taken for r in mix) > 0


def test_registered():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and set(SQL) <= set(QUERIES)

