"""Secret scan: every value of a key-like name and run of key-like characters, judged by a random forest.

Candidates are, in whole texts, all values that are assigned to a key-like name or stand quoted
after one, whatever their length and characters, and elsewhere runs of at least `SHORTEST`
characters of A-Z a-z 0-9 + / = _ - (a run that lies inside a value is part of it). A value in
quotes ends at the closing quote or the end of the line; one without quotes at white space, less
the , ; ) ] } > and quotes that end it. A forest trained from labelled findings removes false positives. It sees the length and character
classes of a candidate, its character transitions (against those of all texts), how much of it
dictionary words cover (the most frequent words of all texts), the path it comes from, and the
words beside it.

Transitions and word counts are taken over all texts, with partial sums in each task. The
dictionary holds at most `DICTIONARY` words. The forest is fitted on at most `max_findings`
labelled findings of either label, chosen by hash.

Defined results: a null text counts as empty and has no candidates; null paths count as empty;
a finding repeats with its row; findings labelled both ways count both times; without labels of
both kinds the score is the share of ones, or 0.5 without any.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.llm.shared import fresh, pieces, settle, texts

SHORTEST = 16
DICTIONARY = 20_000
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % SHORTEST)
# A run of word characters is entered at its start only and its first key-like name decides (what
# follows would end at the same place), so no run is scanned twice, whatever its length.
_VALUE = re.compile(
    r"(?:(?<!\w)(?>\w*?(?:token|secret|passw(?:or)?d|passphrase|passcode|pwd|api_?key"
    r"|auth(?!or(?!i[sz])|entic(?!at))|credential|(?:private|access|signing|encryption)_?key))"
    r"|(?:api|private|access|signing|encryption)-key)\w*+"
    r"(?:[\"']?\]?[ \t]*+(?::=|=>|==?|:)[ \t]*+(?:(?:bearer|basic)[ \t]++)?"
    r"(?:\"((?:[^\"\\\n]|\\.)++)|'((?:[^'\\\n]|\\.)++)|`([^`\n]++)|([^\s\"'`]\S*+))"
    r"|(?:[ \t]++(?:is|was))?[ \t]++(?:\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|`([^`\n]++)`))",
    re.IGNORECASE,
)
#: Every key-like name holds one of these; a value ends on the line of its name.
_NAMES = ("token", "secret", "passw", "passphrase", "passcode", "pwd", "key", "auth", "credential")
#: Ends of values without quotes that belong to what surrounds them.
_ENDING = ",;)]}>\"'`"
_PLAIN = re.compile(r"[a-z]{4,12}")
_NEAR = re.compile(r"[A-Za-z]+")
#: Characters before and after a candidate that its neighbouring words are taken from.
AROUND = 48
KEY_WORDS = frozenset("token secret key apikey password passwd pwd auth bearer credential access private".split())
OTHER_WORDS = frozenset("sha hash commit checksum digest uuid md5 example sample test dummy isbn card".split())
PATH_WORDS = re.compile(r"test|example|sample|mock|fixture|doc|lock|vendor|dist", re.IGNORECASE)
FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "entropy", "class changes", "hex only", "transitions",
    "dictionary coverage", "equals or colon before", "quoted", "key word before", "other word before",
    "key word near", "words before", "path words", "path depth", "path word hash",
)
_KINDS = np.full(128, 28, np.int64)
_KINDS[ord("a") : ord("z") + 1] = np.arange(26)
_KINDS[ord("A") : ord("Z") + 1] = np.arange(26)
_KINDS[ord("0") : ord("9") + 1] = 26
_KINDS[ord(" ")] = 27
KINDS = 29


def _kinds(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _KINDS[np.minimum(points, 127)]


@dataclass
class Language:
    """Logarithms of the character transitions of all texts, and their most frequent words."""

    transitions: np.ndarray
    words: frozenset[str] = field(default_factory=frozenset)

    def coverage(self, text: str) -> float:
        """Share of the characters that the longest dictionary words from left to right cover."""
        low, at, covered = text.lower(), 0, 0
        while at < len(low):
            for size in range(min(12, len(low) - at), 3, -1):
                if low[at : at + size] in self.words:
                    covered += size
                    at += size
                    break
            else:
                at += 1
        return covered / max(1, len(low))


def _value_matches(text: str) -> Iterator[re.Match]:
    """Matches of _VALUE, looked for on lines that hold a name at all."""
    folded = text.casefold()
    if not any(name in folded for name in _NAMES):
        return
    at = 0
    for line in text.split("\n"):
        folded = line.casefold()
        if any(name in folded for name in _NAMES):
            yield from _VALUE.finditer(text, at, at + len(line))
        at += len(line) + 1


def spans(text: str) -> list[tuple[int, int]]:
    """Where candidates stand: values of key-like names, and key-like runs outside of these."""
    values = []
    for match in _value_matches(text):
        start, end = match.span(match.lastindex)
        if match.lastindex == 4:
            end = start + (len(match[4].rstrip(_ENDING)) or len(match[4]))
        values.append((start, end))
    if not values:
        return [m.span() for m in _CANDIDATE.finditer(text)]
    out, at = [], 0
    for match in _CANDIDATE.finditer(text):
        start, end = match.span()
        while at < len(values) and values[at][1] <= start:
            at += 1
        # what a value leaves of a run is a candidate of its own if it is long enough
        k = at
        while k < len(values) and values[k][0] < end:
            if values[k][0] - start >= SHORTEST:
                out.append((start, values[k][0]))
            start = max(start, values[k][1])
            k += 1
        if end - start >= SHORTEST:
            out.append((start, end))
    return sorted(values + out)


def learn_language(docs: DataFrame, text_col: str) -> Language:
    """Counts over all texts; tasks sum up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words = np.zeros(KINDS * KINDS, np.int64), Counter()

        def give(some: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"key": pa.array(list(some), pa.string()), "n": pa.array(list(some.values()), pa.int64())}
            )

        for batch in pieces(batches):
            for text in texts(batch.column(0)):
                kinds = _kinds(text)
                pairs += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
                words.update(_PLAIN.findall(text))
            if len(words) > 1 << 19:
                yield give(words)
                words = Counter()
        yield give(words)
        yield give(Counter({f"#{k}": int(n) for k, n in enumerate(pairs) if n}))

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "key string, n long")
    counts = settle(rows.groupBy("key").agg(F.sum("n").alias("n")))
    is_pair = F.col("key").startswith("#")
    pairs = np.ones(KINDS * KINDS)
    for row in counts.where(is_pair).collect():
        pairs[int(row.key[1:])] += row.n
    pairs = pairs.reshape(KINDS, KINDS)
    level = F.floor(F.log2("n") * 16)
    held, least = 0, None
    for row in sorted(counts.where(~is_pair).groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        held += row["count"]
        if held > DICTIONARY:
            break
        least = row.level
    words = counts.where(~is_pair & (level >= least)).collect() if least is not None else []
    transitions = np.log(pairs / pairs.sum(axis=1, keepdims=True))
    return Language(transitions, frozenset(r.key for r in words))


def describe(candidate: str, before: str, after: str, path: str, language: Language) -> list[float]:
    """The values of FEATURES."""
    size = len(candidate)
    counts = Counter(candidate)
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    kinds = _kinds(candidate)
    classes = np.where(kinds == 26, 0, np.where(kinds == 28, 1, 2))
    cased = np.frombuffer(candidate.encode("utf-32-le"), np.uint32)
    classes = np.where((cased >= 65) & (cased <= 90), 3, classes)
    near = [w.lower() for w in _NEAR.findall(before)][-3:]
    following = [w.lower() for w in _NEAR.findall(after)][:2]
    close = before.rstrip("\"' ")
    segments = [p for p in path.split("/") if p]
    return [
        math.log(size),
        sum(c.isdigit() for c in candidate) / size,
        sum(c.isupper() for c in candidate) / size,
        sum(c.islower() for c in candidate) / size,
        sum(not c.isalnum() for c in candidate) / size,
        entropy,
        float((classes[1:] != classes[:-1]).mean()) if size > 1 else 0.0,
        float(re.fullmatch(r"[0-9a-fA-F]+", candidate) is not None),
        float(language.transitions[kinds[:-1], kinds[1:]].mean()) if size > 1 else 0.0,
        language.coverage(candidate),
        float(close.endswith(("=", ":"))),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(bool(KEY_WORDS.intersection(near[-1:]))),
        float(bool(OTHER_WORDS.intersection(near[-1:]))),
        float(bool(KEY_WORDS.intersection(near + following))),
        float(len(near)),
        float(len(PATH_WORDS.findall(path))),
        float(len(segments)),
        float(sum(map(ord, segments[-1])) % 17) if segments else 0.0,
    ]


class RandomForest:
    """Trees of axis splits on bootstrap samples; a score is the mean share of ones in the leaves."""

    def __init__(self, trees: int = 24, depth: int = 9, least: int = 3, seed: int = 5):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        #: One array of nodes for each tree: feature (-1 in a leaf), limit, left, right, share.
        self.nodes: list[np.ndarray] = []
        self.base = 0.5

    def fit(self, values: np.ndarray, labels: np.ndarray) -> "RandomForest":
        rng = np.random.default_rng(self.seed)
        if len(labels):
            self.base = float(labels.mean())
        if len(labels) and 0 < self.base < 1:
            for _ in range(self.trees):
                chosen = rng.integers(0, len(labels), len(labels))
                self.nodes.append(self._tree(values[chosen], labels[chosen], rng))
        return self

    def _tree(self, values: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        nodes: list[list[float]] = []
        waiting = [(np.arange(len(labels)), 0, -1, 0)]
        while waiting:
            rows, depth, parent, side = waiting.pop()
            number = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(labels[rows].mean())])
            if parent >= 0:
                nodes[parent][side] = number
            if depth == self.depth or len(rows) < 2 * self.least or nodes[number][4] in (0.0, 1.0):
                continue
            split = self._best_split(values[rows], labels[rows], rng)
            if split is None:
                continue
            nodes[number][:2] = split
            left = values[rows, split[0]] <= split[1]
            waiting += [(rows[left], depth + 1, number, 2), (rows[~left], depth + 1, number, 3)]
        return np.array(nodes)

    def _best_split(self, values: np.ndarray, labels: np.ndarray, rng: np.random.Generator):
        best, found, size = 1e-9, None, len(labels)
        share = labels.mean()
        for feature in rng.permutation(values.shape[1])[: int(math.sqrt(values.shape[1])) + 1]:
            order = np.argsort(values[:, feature], kind="stable")
            column, ones = values[order, feature], np.cumsum(labels[order])
            left = np.arange(1, size)
            cut = (column[1:] > column[:-1]) & (left >= self.least) & (size - left >= self.least)
            if not cut.any():
                continue
            at = left[cut]
            p, q = ones[at - 1] / at, (ones[-1] - ones[at - 1]) / (size - at)
            gain = share * (1 - share) - (at * p * (1 - p) + (size - at) * q * (1 - q)) / size
            k = int(gain.argmax())
            if gain[k] > best:
                best = gain[k]
                found = (int(feature), float((column[at[k] - 1] + column[at[k]]) / 2))
        return found

    def scores(self, values: np.ndarray) -> np.ndarray:
        if not self.nodes or not len(values):
            return np.full(len(values), self.base)
        total = np.zeros(len(values))
        for nodes in self.nodes:
            at = np.zeros(len(values), np.int64)
            for _ in range(self.depth):
                feature = nodes[at, 0].astype(np.int64)
                inner = feature >= 0
                below = values[np.arange(len(values)), np.maximum(feature, 0)] <= nodes[at, 1]
                at = np.where(inner, np.where(below, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)
            total += nodes[at, 4]
        return total / len(self.nodes)


def candidates(
    docs: DataFrame, keep: list[str], text_col: str = "text", path_col: str | None = "source"
) -> DataFrame:
    """One row per candidate: keep, start, end (code points), candidate, before, after, path."""
    names = fresh(keep, "start", "end", "candidate", "before", "after", "path")
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            paths = texts(batch.column(len(keep) + 1))
            rows = [
                (k, start, end, t[start:end], t[max(0, start - AROUND) : start], t[end : end + AROUND], paths[k])
                for k, t in enumerate(texts(batch.column(len(keep))))
                for start, end in spans(t)
            ]
            if not rows:
                continue
            made = list(zip(*rows))
            own = [column.take(pa.array(made[0], pa.int64())) for column in batch.columns[: len(keep)]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*own, *[pa.array(v, kind) for v, kind in zip(made[1:], kinds)]],
                names=[*keep, *names],
            )

    schema = T.StructType([docs.schema[n] for n in keep])
    for k, name in enumerate(names):
        schema = schema.add(name, T.LongType() if k < 2 else T.StringType())
    chosen = docs.select(*[F.col(f"`{n}`") for n in keep], F.col(f"`{text_col}`").alias("text"), path.alias("path"))
    return chosen.mapInArrow(run, schema)


def described(found: DataFrame, keep: list[str], language: Language, label: Column | None = None) -> DataFrame:
    """keep, start, end, candidate_sha256, label and the values of FEATURES of each row of candidates.

    What is stored of these rows holds no candidate in plain.
    """
    held = found.sparkSession.sparkContext.broadcast(language)

    @F.pandas_udf("array<double>")
    def values(candidate: pd.Series, before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([describe(*row, held.value) for row in zip(candidate, before, after, path)], dtype=object)

    return found.select(
        *[F.col(f"`{n}`") for n in keep], "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"),
        (F.lit(None) if label is None else label).cast("int").alias("label"),
        values("candidate", "before", "after", "path").alias("features"),
    )


def fit_described(rows: DataFrame, max_findings: int = 5_000, **options) -> RandomForest:
    """A forest from the labelled ones of described rows: of either label at most `max_findings`
    different ones, those with the smallest hashes."""
    labelled = rows.where("label is not null").select("label", "candidate_sha256", "features").distinct()
    mark = F.xxhash64("candidate_sha256", "features")
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    values: list[list[float]] = []
    labels: list[float] = []
    for value in sorted(counts):
        near = (F.col("label") == value) & (F.pmod(mark, F.lit(counts[value])) < 2 * max_findings)
        for row in labelled.where(near).orderBy(mark, "candidate_sha256", "features").limit(max_findings).collect():
            values.append(row.features)
            labels.append(float(value > 0))
    return RandomForest(**options).fit(np.array(values).reshape(-1, len(FEATURES)), np.array(labels))


def fit(
    findings: DataFrame, label: Column, language: Language, max_findings: int = 5_000, **options
) -> RandomForest:
    """A forest from labelled findings, which have candidate, before, after and path; null labels don't count."""
    chosen = findings.select("candidate", "before", "after", "path", F.lit(0).alias("start"), F.lit(0).alias("end"),
                             label.cast("int").alias("label"))
    rows = described(chosen.where("label is not null"), [], language, F.col("label"))
    return fit_described(settle(rows), max_findings, **options)


def judge_described(rows: DataFrame, forest: RandomForest) -> Column:
    """The forest's score of each described row."""
    held = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(np.array(features.tolist()).reshape(-1, len(FEATURES))))

    return score("features")


def judge(found: DataFrame, forest: RandomForest, language: Language) -> Column:
    """The forest's score of each row of candidates."""
    held = found.sparkSession.sparkContext.broadcast((forest, language))

    @F.pandas_udf("double")
    def score(candidate: pd.Series, before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
        model, known = held.value
        values = [describe(*row, known) for row in zip(candidate, before, after, path)]
        return pd.Series(model.scores(np.array(values).reshape(-1, len(FEATURES))))

    return score("candidate", "before", "after", "path")


def assigned_label(before: Column, candidate: Column) -> Column:
    """A label for findings that nobody has labelled: 1 for a value assigned to a key-like name,
    0 for runs of digits, words, hashes, UUIDs and paths elsewhere, null for all others."""
    name = r"(?i)(token|secret|passw(or)?d|passphrase|passcode|pwd|api[_-]?key|auth|credential|(private|access|signing|encryption)[_-]?key)\w*"
    named = before.rlike(
        name + r"(\s*[=:]\s*[\"']?|[\"']?\]?\s*(:=|=>|==?|:)\s*((bearer|basic)\s+)?[\"'`]?|(\s+(is|was))?\s+[\"'`])$"
    )
    near = before.rlike(r"(?i)(token|secret|passw|pwd|key|auth|credential|bearer)[^\n]*$")
    plain = candidate.rlike(r"^([0-9]+|[A-Za-z]+|[=_-]+)$")
    mixed = candidate.rlike(r"[0-9]") & candidate.rlike(r"[A-Za-z]")
    uuid = candidate.rlike(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")
    digest = candidate.rlike(r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$")
    # possessive, so that long candidates take neither stack nor time; a folder is read from its end
    folders = F.slice(F.split(candidate, "/"), 1, F.size(F.split(candidate, "/")) - 1)
    wordy = F.exists(folders, lambda name: F.reverse(name).rlike(r"^[a-z0-9_-]*?[a-z]{3}"))
    path = candidate.rlike(r"^/?(?:[A-Za-z0-9_-]++/){2,}+[A-Za-z0-9_-]*+$") & wordy
    file_name = candidate.rlike(r"^[A-Za-z]{3,}+(?:[_-][A-Za-z0-9]++)++$")
    return (
        F.when(named & mixed, 1)
        .when(plain & ~named, 0)
        .when((uuid | digest | path | file_name) & ~named & ~near, 0)
    )
