"""Line dedup, SimHash groups, repeated passages and leaks against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from loantide.llm import decontaminate, line_dedup, simhash, suffixes
from loantide.llm.common import components


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(500, 700)]
    links += [(900, i) for i in range(901, 1200)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {n: find(n) for n in root if find(n) != n}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- lines


def plain_lines(rows):
    """Later windows of three lines, by (id, NULL last); ids of these rows differ or the rows are equal."""
    seen, out = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip(" "):
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.setdefault(w, (i, p))
        out[i, t] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return sorted((str(i), str(out[i, t])) for i, t in rows)


def test_lines(frame):
    a, b = "l1\nl2\nl3", "\n\n\n\n"
    rows = [(1, f"{a}\nx\ny"), (2, f"p\n{a}\nq"), (3, f"{a}\nx\ny"), (4, "r\n" * 9), (5, b), (6, b), (7, None), (8, "l1\nl2"), (9, "")]
    rows += [(None, f"z\n{a}"), (2, f"p\n{a}\nq"), (10, "\n".join(random.Random(1).choices("abc", k=200)))]
    df = frame(rows)
    out = line_dedup.drop_repeated_lines(df)
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == plain_lines(rows)
    assert out.columns == [*df.columns, "removed_lines"]
    assert line_dedup.drop_repeated_lines(df, count_column=None).columns == df.columns
    assert line_dedup.drop_repeated_lines(df.where("false")).count() == 0


# ---- SimHash


def plain_print(text, length=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + length]) for i in range(max(1, len(words) - length + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bits", range(8))
def test_cells_hold_every_pair(bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 150, dtype=np.uint64)
    near = base.copy()
    for i in range(len(near)):
        for b in rng.choice(64, bits, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    steps = (bits // 2 + 1) // 2
    held = []
    for prints in (base, near):
        rows, found = simhash.cells(prints, steps)
        own = [set() for _ in prints]
        for r, c in zip(rows.tolist(), found.tolist()):
            own[r].add(c)
        held.append(own)
    assert all(a & b for a, b in zip(*held))


def test_popcounts_bound_the_distance():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(2))
    split = lambda x: (simhash.popcounts(x)[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    manhattan = np.abs(split(a).astype(int) - split(b).astype(int)).sum(axis=1)
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def near_rows(prose):
    rows = [(100 + i, prose(i, 60)) for i in range(40)]
    for k in range(30):
        words = prose(k % 6, 60).split()
        words[k] = "CHANGED"
        rows.append((300 + k, " ".join(words)))
    long = prose(77, 3000)
    return rows + [(400 + i, " ".join([*long.split()[:-1], f"end{i}"])) for i in range(40)] + [(500, prose(3, 60).upper())]


def test_simhash_components(frame, prose, odd):
    rows = near_rows(prose) + odd
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(frame(rows)).collect()]
    prints = [plain_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        before = list(group)
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    group[i] = min(group[i], group[j])
        if group == before:
            break
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = [(rows[i][0], format(prints[i], "016x"), least[group[i]]) for i in range(len(rows))]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.drop_near_copies(frame(rows))
    assert kept.columns == frame(rows).columns and kept.count() == len(set(group))
    assert simhash.drop_near_copies(frame(rows).where("false")).count() == 0
    assert simhash.simhash_components(frame(rows).where("false")).count() == 0


def test_full_cells_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rng = np.random.default_rng(4)
    centre, prints = np.uint64(0x0123456789ABCDEF), set()
    while len(prints) < 700:
        x = centre
        for b in rng.choice(64, 2, replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        prints.add(int(x.view(np.int64)))
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    groups = simhash.fingerprint_groups(df, 4)
    assert groups.count() == 700 and groups.select("group").distinct().count() == 1
    links = simhash.close_prints(df, 4)
    assert links.count() < 700 * 50 * 30, "a forest per block, not every pair"


# ---- passages


def plain_passages(rows, n):
    seen, covered = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        words = (t or "").encode().split()
        own = set()
        for p in range(len(words) - n + 1):
            w = tuple(words[p : p + n])
            if w in seen:
                own.update(range(p, p + n))
            seen.add(w)
        if own:
            covered[i] = own
    return covered


@pytest.mark.parametrize("n,gram", [(50, 12), (12, 5), (6, 6)])
def test_passages(frame, prose, n, gram):
    rng = random.Random(n)
    shared = [prose(1000 + k, rng.randint(n - 2, 3 * n)) for k in range(6)]
    rows = [(i, " ".join([prose(i, rng.randint(0, 40)), rng.choice(shared), prose(50 + i, rng.randint(0, 40)), rng.choice(shared)])) for i in range(40)]
    rows += [(100, "so so " * 100), (101, "so so " * 70), (102, None), (103, ""), (3, rows[3][1]), (None, shared[0]), (104, "é " * (n - 1))]
    got = {}
    for r in suffixes.repeated_passages(frame(rows), passage=n, gram=gram).collect():
        stretch = set(range(r.start_word, r.end_word))
        assert not stretch & got.get(r.doc_id, set())
        got.setdefault(r.doc_id, set()).update(stretch)
    assert got == plain_passages(rows, n)
    assert suffixes.repeated_passages(frame(rows).where("false")).count() == 0


# ---- leaks


def split(text):
    return [w for w in re.split(r"[^a-z0-9é]+", text.lower()) if w]


def grams(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_leaks(spark, frame, prose, odd):
    items = [(i, prose(900 + i, 12 + 3 * i).capitalize() + ".") for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = list(odd)
    for i in range(36):
        words = items[i % 12][1].split()
        if i >= 12:
            words[random.Random(i).randrange(len(words))] = "other"
        if i >= 24:
            words.insert(len(words) // 2, "more")
        rows.append((100 + i, f"{prose(i, i)} {' '.join(words).upper()}, {prose(i + 40, 36 - i)}"))
    rows += [(200, items[3][1]), (201, " ".join(items[11][1].split()[:-2])), (100, rows[8][1])]
    want = {}
    for i, t in rows:
        words = split(t or "")
        for item, text in items:
            other = split(text or "")
            theirs, spots = grams(other), set()
            for p, g in enumerate(zip(*[words[k:] for k in range(5)])):
                for q, h in enumerate(zip(*[other[k:] for k in range(5)])):
                    if g == h:
                        spots.add(max(0, min(p - q, len(words) - len(other))))
            for s in spots:
                mine = grams(words[s : s + len(other)])
                similarity = sum((mine & theirs).values()) / sum((mine | theirs).values())
                if similarity >= 0.8:
                    want[i, item] = max(similarity, want.get((i, item), 0))
    found = decontaminate.leaked_items(frame(rows), bench)
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    assert got == pytest.approx(want) and any(v < 1 for v in want.values())
    clean = decontaminate.drop_contaminated(frame(rows), bench)
    assert clean.columns == frame(rows).columns
    leaked = {i for i, _ in want}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in leaked)
    assert decontaminate.leaked_items(frame(rows), bench.where("false")).count() == 0
    assert decontaminate.leaked_items(frame(rows).where("false"), bench).count() == 0


def test_leaks_in_any_order(spark, frame, prose):
    """Every window of every document, where halves are swapped and blocks moved."""
    sizes = [100, 100, 60, 45, 45]
    items = [(i, " ".join(f"{w}{i}" if k % 3 else w for k, w in enumerate(prose(700 + i, n).split()))) for i, n in enumerate(sizes)]
    rows = []
    for i, text in items:
        words = text.split()
        n = len(words)
        for k, cut in enumerate((n // 2, n // 3, n - 9, 5)):
            rows.append((10 * i + k, f"{prose(i + k, 60 + 20 * k)} {' '.join(words[cut:] + words[:cut])} {prose(i + 30, 60)}"))
        rows.append((10 * i + 4, f"{prose(i, 30)} {' '.join(words[: n // 2])} {prose(i + 9, 3)} {' '.join(words[n // 2 :])}"))
        rows.append((10 * i + 5, " ".join(words[n // 2 :] + words[: n // 2 - 2])))
    want = {}
    for i, t in rows:
        words = split(t)
        for item, text in items:
            other = split(text)
            theirs = grams(other)
            for s in range(max(0, len(words) - len(other)) + 1):
                mine = grams(words[s : s + len(other)])
                similarity = sum((mine & theirs).values()) / sum((mine | theirs).values())
                if similarity >= 0.8:
                    want[i, item] = max(similarity, want.get((i, item), 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaked_items(frame(rows), bench).collect()}
    assert got == pytest.approx(want)
    assert want[0, 0] == pytest.approx(0.92), "two halves of 50 words, swapped"
    assert 0 not in {r.doc_id for r in decontaminate.drop_contaminated(frame(rows), bench).collect()}
