"""Secret scan by assignment-aware lexing.

Base kinds are plain patterns. The method adds kind ``literal``: source and configuration syntax is lexed
into name-literal pairs, constants are propagated through names and concatenations, and a literal that ends in a
sensitive target name is scored by that name and by its own look.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
# A run too short to count cannot hold a longer one, so the least length may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Weight of a word in a target name.
NAME_WEIGHTS = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.9,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 0.95,
    "credential": 0.9,
    "credentials": 0.9,
    "privatekey": 0.95,
    "accesskey": 0.95,
    "auth": 0.7,
    "key": 0.6,
}
#: Weight from which a name is strongly sensitive: quoted literals with white space count too.
STRONG = 0.9
_SENSITIVE = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "auth")
_PLACEHOLDER_WORD = re.compile(r"example|sample|change_?me|placeholder|dummy|your|todo", re.I)
_FILLER = re.compile(r"[x*.]*$", re.I)
_PLACEHOLDER = re.compile(r"example|sample|change_?me|placeholder|dummy|your|todo|^[x*.]+$|^<.*>$|^\$\{.*\}$|^%\(.*\)", re.I)
_TERM = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[^\s,;\"'+(){}\[\]<>]++"
_PAIR = re.compile(
    rf"(?<![\w.\-])([A-Za-z_][\w.\-]*+)[\"']?[ \t]*+(?::=|=>|[=:])(?![=:])[ \t]*+((?:{_TERM})(?:[ \t]*+\+[ \t]*+(?:{_TERM}))*+)"
)
_ONE = re.compile(_TERM)
_NAME = re.compile(r"[A-Za-z_][\w.\-]*+$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """Greatest weight of the words of a target name; neighbours such as api and key count as one word too."""
    words = [w.lower() for w in _WORDS.findall(name)]
    words += [a + b for a, b in zip(words, words[1:])]
    return max((NAME_WEIGHTS.get(w, 0.0) for w in words), default=0.0)


def literal_score(value: str, spaced: bool = False) -> float:
    """0 to 1: short or placeholder text, and spaced text unless allowed, scores 0; else the entropy per character against 3.5 bits."""
    if len(value) < 8 or _PLACEHOLDER.search(value) or not spaced and any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, entropy / 3.5)


def _pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int, bool]]]]:
    """(name, terms) of each assignment; a term is its start, end and whether it is quoted."""
    for m in _PAIR.finditer(text):
        terms = []
        for t in _ONE.finditer(text, m.start(2), m.end(2)):
            quoted = text[t.start()] in "\"'"
            terms.append((t.start() + quoted, t.end() - quoted, quoted))
        yield m.group(1), terms


class _Value:
    """What the score of a concatenation needs, from its parts in order: length, letters, and whether it looks like a placeholder."""

    __slots__ = ("length", "letters", "spaced", "named", "filler", "head", "tail")

    def __init__(self) -> None:
        self.length, self.letters, self.spaced, self.named, self.filler, self.head, self.tail = 0.0, Counter(), False, False, True, "", ""

    def add_text(self, part: str) -> None:
        self.length += len(part)
        self.letters.update(part)
        self.spaced |= any(c.isspace() for c in part)
        self.named |= _PLACEHOLDER_WORD.search(part) is not None
        self.filler &= _FILLER.match(part) is not None
        self.head, self.tail = (self.head + part[:2])[:2], (self.tail + part[-1:])[-1:]

    def add(self, other: _Value) -> None:
        self.length += other.length
        self.letters.update(other.letters)
        self.spaced |= other.spaced
        self.named |= other.named
        self.filler &= other.filler
        self.head, self.tail = (self.head + other.head)[:2], (self.tail + other.tail)[-1:]
        if self.length > 1e12:  # doubled over and over; only the shares of letters count
            self.length /= 1e12
            self.letters = Counter({c: n / 1e12 for c, n in self.letters.items()})
            self.length = max(self.length, 8.0)

    def score(self, spaced: bool) -> float:
        """As :func:`literal_score` of the whole."""
        wrapped = (self.head[:1], self.tail) == ("<", ">") or (self.head, self.tail) == ("${", "}") or self.head == "%("
        if self.length < 8 or self.named or self.filler or wrapped or self.spaced and not spaced:
            return 0.0
        total = sum(self.letters.values())
        return min(1.0, -sum(c / total * math.log2(c / total) for c in self.letters.values() if c) / 3.5)


def _assignments(text: str) -> tuple[list[str], list[list]]:
    """Names, and for each assignment its terms: spans of literals, and numbers of the assignments that names stand for.

    A name stands for its latest assignment above, or, where there is none, for its last one below.
    """
    pairs = list(_pairs(text))
    last = {name: at for at, (name, _) in enumerate(pairs)}
    latest: dict[str, int] = {}
    terms = []
    for at, (name, own) in enumerate(pairs):
        found: dict = {}
        for start, end, quoted in own:
            word = text[start:end]
            if not quoted and word in last and _NAME.match(word):
                found[latest.get(word, last[word])] = None
            else:
                found[start, end] = None
        terms.append(list(found))
        latest[name] = at
    return [name for name, _ in pairs], terms


def _groups(terms: list[list], roots: list[int]) -> tuple[list[list[int]], dict[int, int]]:
    """Assignments that the roots reach, in groups that refer to one another, referred ones first; and the group of each (Tarjan 1972)."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    group: dict[int, int] = {}
    groups: list[list[int]] = []
    open_: list[int] = []
    for root in roots:
        if root in number:
            continue
        walk = [(root, iter(terms[root]))]
        number[root] = low[root] = len(number)
        open_.append(root)
        while walk:
            at, rest = walk[-1]
            for to in rest:
                if isinstance(to, int):
                    if to not in number:
                        number[to] = low[to] = len(number)
                        open_.append(to)
                        walk.append((to, iter(terms[to])))
                        break
                    if to not in group:
                        low[at] = min(low[at], number[to])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[at])
                if low[at] == number[at]:
                    members = []
                    while not members or members[-1] != at:
                        members.append(open_.pop())
                        group[members[-1]] = len(groups)
                    groups.append(sorted(members))
    return groups, group


def literal_spans(text: str, threshold: float) -> list[tuple[int, int, float]]:
    """Literals that reach a sensitive name, straight or through constants; strongly sensitive names take spaced ones too.

    Names form a graph of assignments. Those that refer to one another in a circle share all their literals. Each assignment that a sensitive name
    needs is valued once, from the values of what it refers to, and each literal takes the greatest score of the names that it reaches: the
    work follows the text's length, however constants are chained.
    """
    names, terms = _assignments(text)
    weights = {name: name_score(name) for name in set(names)}
    roots = [at for at, name in enumerate(names) if weights[name] and terms[at]]
    groups, group = _groups(terms, roots)
    values: list[_Value] = []
    for number, members in enumerate(groups):
        value = _Value()
        for at in members:
            for term in terms[at]:
                if not isinstance(term, int):
                    value.add_text(text[term[0] : term[1]])
                elif group[term] != number:
                    value.add(values[group[term]])
        values.append(value)
    scored: dict[int, float] = {}
    for at in roots:
        weight = weights[names[at]]
        score = weight * values[group[at]].score(weight >= STRONG)
        if score >= threshold:
            scored[group[at]] = max(score, scored.get(group[at], 0.0))
    found: dict[tuple[int, int], float] = {}
    seen: set[int] = set()
    for start, score in sorted(scored.items(), key=lambda x: -x[1]):
        walk = [start]
        while walk:
            number = walk.pop()
            if number in seen:
                continue
            seen.add(number)
            for at in groups[number]:
                for term in terms[at]:
                    if isinstance(term, int):
                        walk.append(group[term])
                    else:
                        found.setdefault(term, score)
    return [(a, b, s) for (a, b), s in found.items()]


def find_secrets(text: str, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) of one text by start, then kind; ends are exclusive, in code points."""
    found = [("hex", m.start(), m.end(), 1.0) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), 1.0) for m in _ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        low = text.lower()
        if any(s in low for s in _STEMS):
            found += [("assign", m.start(), m.end(), 1.0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if any(s in low for s in _SENSITIVE):
            found += [("literal", a, b, s) for a, b, s in literal_spans(text, threshold)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
)


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: its id and ``spans``, an array of (kind, start, end, score).

    Texts are scanned whole, each row on its own, so repeated rows and ids give a row each. A NULL
    text counts as empty, a NULL id stays NULL; other columns are not read, whatever their names. An empty table gives
    no rows. Spans of different kinds may overlap; those of one kind, bar ``literal``, do not.
    """
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("spans", SPANS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find_secrets(t.as_py() or "", threshold)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW)], names=[id_column, "spans"])

    return docs.select(id_column, docs[text_column].cast("string")).mapInArrow(scan, schema)
