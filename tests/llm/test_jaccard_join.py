"""The join against all pairs by brute force, for both thresholds and small cost limits."""

import random
import re

import numpy as np
import pytest

from citewerk.llm import jaccard_join
from citewerk.llm.components import components
from citewerk.llm.jaccard_join import Bands, keep_one_each, similar_groups
from citewerk.llm.shared import LOWER_BYTES, WORD


def brute(rows, n, percent):
    sets = []
    for _, text in rows:
        w = re.findall(WORD, (text or "").encode().translate(LOWER_BYTES))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    out = []
    for i, s in enumerate(sets):
        ids = [r[0] for k, r in enumerate(rows) if top(k) == top(i) and r[0] is not None]
        out.append((rows[i][0], len(s), min(ids, default=None) if s else rows[i][0]))
    return sorted(out, key=repr)


def corpus(seed, size):
    """Near copies in chains and clusters, shared passages, short texts, repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=3))
    passage = [word() for _ in range(60)]
    rows = []
    while len(rows) < size:
        base = [word() for _ in range(rng.choice([1, 2, 4, 8, 15, 40, 120, 300]))]
        if rng.random() < 0.4:
            base = passage + base
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            other = list(rng.choice([base, rows[-1]]))
            for _ in range(max(1, int(rng.choice([0.01, 0.02, 0.04, 0.08]) * len(other)))):
                at = rng.randrange(len(other))
                if rng.random() < 0.5:
                    other[at] = word()
                else:
                    other.insert(at, word())
            rows.append(other)
    out = [(i, " ".join(r)) for i, r in enumerate(rows)]
    out += [(9_001, None), (9_002, ""), (9_003, " \n"), (9_004, "Ab cd"), (9_005, "aB CD"), (None, "AB cd")]
    return out + [out[3], out[3], (9_006, out[5][1].upper())]


@pytest.mark.parametrize("n, percent, hot, block", [(3, 90, 32, 256), (5, 80, 3, 4)])
def test_against_brute_force(spark, n, percent, hot, block):
    rows = corpus(n * percent + hot, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_groups(docs, words=n, percent=percent, hot=hot, block=block)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, n, percent)


def test_keep_one(spark):
    rows = corpus(5, 120)
    docs = spark.createDataFrame([(*r, "x", r[0]) for r in rows], "doc_id long, text string, n string, id long")
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    stay = {r[0] for r in brute(rows, 5, 80) if r[0] == r[2]}
    assert {r.doc_id for r in kept.collect()} == stay
    assert keep_one_each(docs.limit(0)).count() == 0


def test_bands_hold_every_link():
    """A view never needs more units than the distance of its farthest link plus one."""
    for percent in (80, 90):
        bands = Bands(percent)
        for small in range(1, 400):
            for large in range(small, small * 100 // percent + 1):
                distance = bands.distance(small, large)
                band = bands.band(small)
                of_small = {b: need for b, _, need in bands.views(small)}
                of_large = {b: need for b, _, need in bands.views(large)}
                if bands.segments(band) == 1:
                    assert distance == 0
                    continue
                assert of_small[band] > distance and of_large[band] > distance
                assert bands.segments(band) > distance


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    assert found == {i: top(i) for a, b in edges if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hub", [0, 500, 1000])
def test_components_take_few_rounds(spark, hub):
    """A chain of rising ids and a star: rounds grow with the logarithm, not with the length."""
    if hub:
        edges, limit = [(hub, k) for k in range(1001) if k != hub], 4
    else:
        edges, limit = [(k, k + 1) for k in range(1000)], 22
    rounds = []
    found = components(spark.createDataFrame([*edges, edges[0], (5, 5)], "a long, b long"), rounds)
    assert {r.root for r in found.collect()} == {0} and found.count() == 1001
    assert len(rounds) <= limit


def test_deletions_meet_whole_segments():
    tokens = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 40).astype(np.uint64))
    segment, keys = jaccard_join.deletions(tokens, 3, 5)
    for drop in range(0, 40, 7):
        rest = np.delete(tokens, drop)
        at = jaccard_join.segment_of(tokens, 3, 5)[drop]
        near = dict(zip(*jaccard_join.occupied(rest, 3, 5)))
        assert near[at] in set(keys[segment == at].tolist())


def test_keep_one_by_row(spark):
    """Several null ids and repeated ids with different texts against brute force over rows."""
    rng = random.Random(12)
    texts = [t for _, t in corpus(5, 150) if t and t.strip()]
    rows = [(None if rng.random() < 0.4 else rng.randrange(60), t) for t in texts]
    rows += [(None, "a b c d e f g h"), (None, "a b c d e f g h"), (None, None), (None, ""), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for number, _, root in brute([(k, text) for k, (_, text) in enumerate(rows)], 5, 80):
        groups.setdefault(root, []).append(number)
    got = [tuple(r) for r in keep_one_each(docs).collect()]
    assert len(got) == len(groups)
    left = list(got)
    for members in groups.values():
        own = [rows[k] for k in members]
        here = [r for r in left if r in own]
        assert here, own
        ids = [i for i, _ in own if i is not None]
        assert here[0][0] == (min(ids) if ids else None)
        left.remove(here[0])
    assert not left


@pytest.mark.parametrize("percent", [80, 90])
def test_one_very_common_passage(spark, percent, monkeypatch):
    """Texts that share most of their shingles and are still not all linked: every key is dear, and what
    tasks hand on grows with the views and not with their pairs."""
    rng = random.Random(percent)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    passage = [word() for _ in range(60)]
    few = [[word() for _ in range(4)] for _ in range(12)]
    rows = []
    for i in range(260):
        own = list(passage)
        for _ in range(rng.choice([0, 1, 2, 3])):
            at = rng.randrange(len(own))
            own[at:at] = rng.choice(few)
        rows.append((i, " ".join(own)))
    made = []
    old = jaccard_join._linked_over_dear_keys

    def counted(ask, told, whole, *options):
        found = old(ask, told, whole, *options)
        made.append((found.count(), told.count()))
        return found

    monkeypatch.setattr(jaccard_join, "_linked_over_dear_keys", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_groups(docs, words=3, percent=percent, hot=3, block=16)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, 3, percent)
    assert made and all(links <= 40 * views for links, views in made)


def test_common_counts():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 60))) for _ in range(40)]
    side = rng.random(40) < 0.4
    lists = pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))
    for limit in (0, 16, 10_000):
        jaccard_join.RARE_PAIRS, kept = limit, jaccard_join.RARE_PAIRS
        got = jaccard_join.common(lists, np.array([len(s) for s in sets]), side)
        jaccard_join.RARE_PAIRS = kept
        want = [[len(np.intersect1d(a, b)) for b, t in zip(sets, side) if not t] for a, s in zip(sets, side) if s]
        assert got.tolist() == want


def test_few_occupied_segments(spark):
    """Small universes leave segments empty; sets also meet on these."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(20, 60)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_groups(docs, words=5, percent=80, hot=2, block=8)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, 5, 80)


def test_sketches_never_tell_too_great_a_distance():
    rng = np.random.default_rng(7)
    apart = 0
    for size in (1, 2, 30, 64, 65, 120, 300, 1000):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        for share in (0.0, 0.1, 0.5, 1.0):
            other = rng.integers(0, 1 << 62, int(share * size) + 1).astype(np.uint64)
            b = np.unique(np.r_[a[int(share * len(a)) :], other])
            told = jaccard_join.least_distance(jaccard_join.sketch(a), jaccard_join.sketch(b))
            assert told <= len(np.setxor1d(a, b))
            assert told == jaccard_join.least_distance(jaccard_join.sketch(b), jaccard_join.sketch(a))
            if share == 1.0 and size >= 30:
                apart += 1
                assert told > Bands(80).distance(len(a), len(b))
    assert apart and jaccard_join.least_distance(jaccard_join.sketch(a), jaccard_join.sketch(a)) == 0


def test_only_likely_pairs_are_read_again(spark, monkeypatch):
    """Texts that share a passage and are far from linked: none of their token lists is made or shuffled."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(100)]
    rows = [(i, " ".join(passage + [word() for _ in range(20)])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)]
    read = []
    old = jaccard_join._token_rows

    def counted(docs, wanted, *options):
        read.append(wanted.count())
        return old(docs, wanted, *options)

    monkeypatch.setattr(jaccard_join, "_token_rows", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_groups(docs, words=3, percent=90)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, 3, 90)
    assert sum(read) <= 20, read


def test_dear_keys_of_the_same_views_meet_once(spark, monkeypatch):
    """Variants of one text: a view is sent for each group of dear keys and not for each key."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(60)]
    few = [word() for _ in range(3)]
    rows = []
    for i in range(200):
        own = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3])):
            own[at] = rng.choice(few)
        rows.append((i, " ".join(own)))
    sent = []
    old = jaccard_join._linked_over_dear_keys

    def counted(ask, told, whole, *options):
        sent.append((told.count(), whole.count()))
        return old(ask, told, whole, *options)

    monkeypatch.setattr(jaccard_join, "_linked_over_dear_keys", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_groups(docs, words=3, percent=90, hot=3, block=16)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, 3, 90)
    assert sent and all(told <= 8 * views for told, views in sent), sent


def test_short_views_make_few_keys_and_send_few_sets(spark, monkeypatch):
    """Texts of one passage with four other words each, too far apart to be linked: keys that no other view can
    have, or that are known to be dear, are not made, and whole sets go only where sketches leave a link possible."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    base = [word() for _ in range(80)]
    rows = []
    for i in range(200):
        own = list(base)
        for at in rng.sample(range(80), 4):
            own[at] = word()
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, sent = [], []
    old_map, old_apply = type(docs).mapInArrow, PandasGroupedOpsMixin.applyInArrow

    def mapped(self, *options, **named):
        found = old_map(self, *options, **named)
        if {"key", "view", "segment"} <= set(found.columns):
            made.append(found.count())
        return found

    def applied(self, *options, **named):
        if "tokens" in self._df.columns:
            sent.append(self._df.count())
        return old_apply(self, *options, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", mapped)
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", applied)
    found = similar_groups(docs, words=1, percent=90, hot=3, block=16)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, 1, 90)
    assert sum(made) <= 60 * len(rows), made
    assert sent and sum(sent) <= 4 * len(rows), sent


def test_folded_sketches_tell_the_same():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64)) for size in (90, 300))
    small, large = jaccard_join.sketch(a, 2), jaccard_join.sketch(b, 2)
    words = len(small) // 8
    apart = np.bitwise_count(jaccard_join._words([small], words) ^ jaccard_join._words([large], words)).sum()
    assert apart == jaccard_join.least_distance(small, large) <= len(np.setxor1d(a, b))
