"""Spelling groups and conversation tries against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loantide.llm import prefixes, spelling

LETTERS = "abcdeé"


def edits(word):
    letters = "abcdefghijklmnopqrstuvwxyz" + "éÉàÿ×èü"
    gone = {word[:i] + word[i + 1 :] for i in range(len(word))}
    more = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    other = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (gone | more | other) - {word}


def groups_by_force(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, near = {}, {}
    for w, n in words.items():
        around = [v for v in edits(w) if v in words]
        near[w] = len(around)
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, near[w], words.get(form[w])) for w, n in words.items()}


def variants(spark, frame, docs):
    out = spelling.spelling_groups(frame(docs))
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out.collect()}


@pytest.fixture(scope="module")
def misspelt():
    """Words of four to seven letters over six, in counts that differ by powers, so that near words and chains of forms abound."""
    rng = random.Random(5)
    pool = ["".join(rng.choices(LETTERS, k=rng.randint(4, 7))) for _ in range(900)]
    pool += [w.upper() for w in pool[:50]] + ["étude", "études", "ètude", "x×yzw", "x×yzv"]
    weights = [1 / (1 + rng.random() * 30) ** 2 for _ in pool]
    texts = [(i, " ".join(rng.choices(pool, weights, k=rng.randint(0, 300)))) for i in range(120)]
    return texts + [(200, "chainaa " * 40), (201, "chainab " * 15), (202, "chaincb " * 5)]


def test_spelling_groups_equal_brute_force(spark, frame, misspelt):
    got = variants(spark, frame, misspelt)
    assert got == groups_by_force(misspelt)
    assert any(r[2] != r[1] for r in got if r[1]) and sum(r[4] for r in got) >= 100


def test_odd_rows_of_spelling_groups(spark, frame, odd):
    rows = odd + [(None, None), (12, "a" * 40_000 + " " + "a" * 40_001 + " "), (12, ("b" * 300 + " " + "b" * 301 + " ") * 3), (13, "12 ö × --")]
    assert variants(spark, frame, rows) == groups_by_force(rows)
    assert variants(spark, frame, []) == set()


def test_repeated_rows_count_each(spark, frame):
    assert variants(spark, frame, [(1, "spelling")] * 3 + [(2, "speling spelling")] * 4) == groups_by_force([(1, "spelling")] * 3 + [(2, "speling spelling")] * 4)


def test_a_signature_is_shared_by_every_near_pair(spark):
    """Each edit of a word at each place, whatever part it falls in."""
    words = {"abcab", "aabbaab", "abababab", "aaaaaaaa", "éèàüö"}
    words |= {v for w in list(words) for v in edits(w) if not set(v) & set("ghijklmnopqrstuvwxy")}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(r.a, r.b) for r in spelling.near_words(df).collect()}
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in edits(a) & words}
    assert got == want


def trie_by_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])

    def words(node):
        return len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0

    leaves, saved = Counter(), Counter()
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * words(node)
    return {
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, m in members.items()
    }


def trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for name in ("d", "h1", "rep", "length", "words", "low"):
        df = df.withColumn(name, F.lit("clash"))
    out = prefixes.conversation_trie(df).collect()
    return [
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out
    ]


def test_the_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(140):
        # Few texts, so that conversations share long beginnings; some are copies or prefixes of others.
        length = rng.choice([1, 2, 3, 5, 9, 20])
        rows += [(c, t, "user" if t % 2 else "system", rng.choice(["a b", "a b", "a b", "c"])) for t in range(length)]
    got = trie(spark, rows)
    assert len(got) == len(set(got)) and set(got) == trie_by_force(rows)


def test_odd_rows_of_the_trie(spark):
    rows = [
        (None, 1, "user", "lost"), (0, None, None, None), (0, 2, "user", None), (0, 2, "user", None), (0, 1, "user", "x " * 5_000),
        (1, 5, "user", "tie b"), (1, 5, "user", "tie a"), (1, None, "user", "later"), (2, 0, "user", ""), (3, 0, "user", ""), (23, 0, "a", "b"),
        (24, 0, "a", "b"), (25, 0, "a", "b"), (-7, 0, "a", "b"),
    ]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    assert set(trie(spark, rows)) == trie_by_force(rows)
    assert trie(spark, []) == []


def test_turnless_conversations_end_at_the_root(spark):
    bare = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1]
    rows = [(c, 0, "user", "only turn") for c in bare[:5]]
    assert set(trie(spark, rows)) == trie_by_force(rows) and trie_by_force(rows).pop()[1] == 0


def test_long_conversations_share_a_beginning(spark, monkeypatch):
    """Deeper than a block of the running sums, with a chain of conversations that are prefixes of one another."""
    monkeypatch.setattr(prefixes, "BLOCK", 16)
    rows = [(c, t, "user", f"turn {t}") for c, length in ((1, 150), (2, 149), (3, 64), (4, 65), (5, 10), (6, 150)) for t in range(length)]
    rows += [(7, t, "user", f"turn {t}" if t < 100 else "other") for t in range(130)]
    assert set(trie(spark, rows)) == trie_by_force(rows)


def test_plans_of_the_trie_do_not_grow_with_its_rounds(spark, monkeypatch):
    """Tables that grow in rounds are one scan each, and every step of the search starts from a stored table."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    searched, inputs = prefixes._searched, []

    def step(pending, *others):
        inputs.append(plan(pending))
        return searched(pending, *others)

    monkeypatch.setattr(prefixes, "_searched", step)

    def scans(convs):
        # There is no conversation 20k to open like; up to three first turns go, so all open alike.
        rows = [(20 * k + 16, t, "user", "same" if t < k + 4 else f"own {k}") for k in range(convs) for t in range(16)]
        df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
        before = len(inputs)
        out = prefixes.conversation_trie(df)
        return plan(out).count("Relation ["), len(inputs) - before

    (few, fewer_steps), (many, steps) = scans(2), scans(12)
    assert 0 < fewer_steps < steps and few == many
    assert not any("Join" in p for p in inputs)
