"""Exact n-gram Jaccard self-join by universe partition and the pigeonhole principle.

A text's set holds the hashes of its distinct n-word shingles. Sets come in size bands; in the band
of the smaller set of a pair, hashing deals the universe of shingles into m segments, more than the
greatest Hamming distance U that two linked sets of the band can have. So linked sets agree on some
whole segment: each set enters the index with one key for each segment that is not empty, in its own
band and, where smaller partners may be there, in the band below (its two `views`).

Cost-based allocation. The number of rows that share a key is its cost. A view that has U + 1 keys
below `hot` does without its hot ones: all its links show in the others. A view that has fewer is
`short`; short views also enter the one-deletion neighbourhoods of their segments, where a segment
counts twice, as it meets partners that differ in it by one shingle, and the keys of their empty
segments, so that no view lacks units. Views that are still short meet over hot keys, but only each
other, only across components that are not known to be one, and each over its cheapest segments, as
many as it lacks units; keys that hold much the same views go together, and their sets are compared
inside tasks, block by block, and give a spanning forest of their links instead of their pairs. Sketches
go to every block, whole sets only where a sketch of the block leaves a link possible.

Keys of short views are not made where they can meet nothing: those with a shingle that no other short
class has, neighbours that no view has whole, and neighbours of dear segments, which are dear as well.

Pairs are first held against their sketches, a bit for each of about as many buckets as a set has
shingles, which tells whether an odd number of them lies there: no fewer shingles than bits differ, so
no link is lost. Links are verified exactly on the whole sets of the pairs that are left. Components grow in two steps: every key first links
its members with its smallest one, so a group of any size takes as many pairs as rows; only pairs
across components are listed after that. Equal sets are one class throughout and never paired.

Defined results: a null or empty text, or one without words, has no shingles and is linked with
nothing; with fewer words than n the whole sequence is the one shingle; component_id is the
smallest id that links reach (null ids are reached like others, smaller than none); rows that repeat
are separate rows of one class; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.llm.bloom import MemberFilter, drop_ids
from citewerk.llm.components import components, forest
from citewerk.llm.shared import fresh, pieces, raw_texts, settle
from citewerk.llm.words import mix, word_hashes

HOT = 32
#: Views of a dear key in a block, tokens of theirs in one matrix, and pairs of sets that a token is
#: counted in one by one; below, tokens of all views of a block.
BLOCK, TOKENS_AT_ONCE, RARE_PAIRS = 512, 4096, 16
TOKENS_IN_BLOCK = 1 << 18
BAND_GROWTH = 1.5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text."""
    hashes, sizes = word_hashes(texts)
    out, at = [], 0
    for size in sizes.tolist():
        words = hashes[at : at + size]
        at += size
        width = min(n, size)
        if not width:
            out.append(np.empty(0, np.uint64))
            continue
        rolled = np.zeros(size - width + 1, np.uint64)
        for k in range(width):
            rolled = mix(rolled * _ODD + words[k : size - width + 1 + k])
        out.append(np.unique(rolled + np.uint64(width)))
    return out


class Bands:
    """Size bands, their segments, and how many units a view needs; all in whole numbers.

    The threshold is `percent` hundredths.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.lower = [1]

    def _reach(self, size: int) -> None:
        while self.lower[-1] <= size:
            self.lower.append(max(self.lower[-1] + 1, int(np.ceil(self.lower[-1] * BAND_GROWTH))))

    def band(self, size: int) -> int:
        self._reach(size)
        return int(np.searchsorted(self.lower, size, "right")) - 1

    def distance(self, small: int, large: int) -> int:
        """Greatest Hamming distance of linked sets of these sizes."""
        return (small + large) * (100 - self.percent) // (100 + self.percent)

    def units(self, size: int, band: int) -> int:
        """More than the distance of any link of a set of this size within the band."""
        largest_small = min(size, self.lower[band + 1] - 1)
        if self.lower[band] <= size < self.lower[band + 1]:
            partner = size * 100 // self.percent
            return max(self.distance(size, partner), self.distance(size, size)) + 1
        return self.distance(largest_small, size) + 1

    def segments(self, band: int) -> int:
        """So many that the largest set of the band rarely leaves too few of them occupied."""
        size = self.lower[band + 1] - 1
        need = self.distance(size, size * 100 // self.percent) + 1
        m = need
        while 1 < need and m < 3 * size:
            empty = m * (1 - 1 / m) ** size
            spread = m * (m - 1) * (1 - 2 / m) ** size + empty - empty**2
            if m - empty - 2 * np.sqrt(max(0.0, spread)) >= need:
                break
            m += 1
        return m

    def views(self, size: int) -> list[tuple[int, int, int]]:
        """(band, segments, units needed) of a set: its own band and perhaps the one below."""
        if not size:
            return []
        home = self.band(size)
        found = []
        for band in (home, home - 1):
            if band < 0 or band < home and size * self.percent > (self.lower[home] - 1) * 100:
                continue
            if band not in self._cached:
                self._cached[band] = self.segments(band)
            m = self._cached[band]
            if m > 1:  # else linked sets of the band are equal
                found.append((band, m, self.units(size, band)))
        return found

    @property
    def _cached(self) -> dict[int, int]:
        return self.__dict__.setdefault("segments_of", {})


def sketch(tokens: np.ndarray, share: int = 1) -> bytes:
    """One bit for each bucket of hashes: whether an odd number of shingles lies in it.

    There are at least `share` buckets a shingle.
    """
    bits = 1 << max(6, (share * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_distance(a: bytes, b: bytes) -> int:
    """A Hamming distance that the sets of two sketches have at least."""
    small, large = sorted((a, b), key=len)
    folded, bits = int.from_bytes(large, "little"), 8 * len(large)
    while bits > 8 * len(small):
        bits //= 2
        folded = (folded >> bits) ^ (folded & ((1 << bits) - 1))
    return (folded ^ int.from_bytes(small, "little")).bit_count()


def segment_of(tokens: np.ndarray, band: int, m: int) -> np.ndarray:
    seed = mix(np.array([band + 1], np.uint64))
    return (mix(tokens ^ seed) % np.uint64(m)).astype(np.int64)


def segment_key(sums: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    return mix(sums + mix(segment.astype(np.uint64) * np.uint64(4096) + np.uint64(band)))


def occupied(tokens: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, key) of the segments that are not empty."""
    where = segment_of(tokens, band, m)
    order = np.argsort(where, kind="stable")
    segments, first = np.unique(where[order], return_index=True)
    sums = np.add.reduceat(mix(tokens * _ODD)[order], first)
    return segments, segment_key(sums, segments, band)


def deletions(tokens: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, key) of all segments of two or more shingles less one of them."""
    where = segment_of(tokens, band, m)
    values = mix(tokens * _ODD)
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, where, values)
    several = np.bincount(where, minlength=m)[where] > 1
    where, values = where[several], values[several]
    return where, segment_key(sums[where] - values, where, band)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _index(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(id, n, k1, k2, sketch, keys, needs) of every row; keys and needs have one entry for each view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in pieces(batches, 256):
            rows = []
            for tokens in shingle_sets(raw_texts(batch.column(1)), n):
                views = bands.views(len(tokens))
                k1 = int((mix(tokens).sum(dtype=np.uint64)).view(np.int64))
                k2 = int((mix(tokens * _ODD + np.uint64(1)).sum(dtype=np.uint64)).view(np.int64))
                keys = [occupied(tokens, band, m)[1].view(np.int64) for band, m, _ in views]
                rows.append((len(tokens), k1, k2, sketch(tokens), keys, [need for _, _, need in views]))
            made = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(made[0], pa.int64()),
                    pa.array(made[1], pa.int64()),
                    pa.array(made[2], pa.int64()),
                    pa.array(made[3], pa.binary()),
                    pa.array(made[4], pa.list_(pa.list_(pa.int64()))),
                    pa.array(made[5], pa.list_(pa.int32())),
                ],
                names=["id", "n", "k1", "k2", "sketch", "keys", "needs"],
            )

    schema = T.StructType().add("id", docs.schema[id_col].dataType)
    for name in ("n", "k1", "k2"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("sketch", T.BinaryType())
    schema = schema.add("keys", T.ArrayType(T.ArrayType(T.LongType())))
    schema = schema.add("needs", T.ArrayType(T.IntegerType()))
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, schema)


def _shared_keys(reps: DataFrame, shared=None) -> DataFrame:
    """(view, key) of the representatives' views; with `shared`, a test for keys, only those it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            views = batch.column(1)
            sizes = views.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(uid)), sizes)
            role = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys = views.flatten()
            view = np.repeat(uid[row] * 2 + role, keys.value_lengths().to_numpy(zero_copy_only=False))
            key = keys.flatten().to_numpy(zero_copy_only=False)
            if shared is not None and len(key):
                held = shared(key)
                view, key = view[held], key[held]
            yield pa.RecordBatch.from_arrays([pa.array(view), pa.array(key)], names=["view", "key"])

    return reps.select("uid", "keys").mapInArrow(run, "view long, key long")


def _token_rows(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(uid, tokens) of the wanted classes (uid, id, k1, k2), read again from their texts.

    A filter of bounded size on the ids keeps other texts from being split again.
    """
    keys = wanted.select(F.xxhash64("id").alias("key"))
    maybe = MemberFilter(keys).may_hold(F.xxhash64(f"`{id_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            sets = shingle_sets(raw_texts(batch.column(1)), n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([int(mix(t).sum(dtype=np.uint64).view(np.int64)) for t in sets], pa.int64()),
                    pa.array([t.view(np.int64) for t in sets], pa.list_(pa.int64())),
                ],
                names=["id", "k1", "tokens"],
            )

    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("k1", T.LongType())
    schema = schema.add("tokens", T.ArrayType(T.LongType()))
    again = (
        docs.where(maybe)
        .select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        .mapInArrow(run, schema)
    )
    # joined by hashes of id and set (equal sets have equal tokens whoever holds them): rows that repeat
    # are then in one place and need no exchange of their own
    again = again.withColumn("mark", F.xxhash64("id"))
    chosen = wanted.select(F.xxhash64("id").alias("mark"), "k1", "uid")
    found = again.join(chosen, ["mark", "k1"])
    return found.dropDuplicates(["mark", "k1", "uid"]).select("uid", "tokens")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be linked by what the sketches (uid, n, sketch) tell; none that is gets lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in pieces(batches, 4096):
            _, _, na, nb, sa, sb = (column.to_pylist() for column in batch.columns)
            near = [
                min(m, n) * 100 >= max(m, n) * percent and least_distance(x, y) <= bands.distance(m, n)
                for m, n, x, y in zip(na, nb, sa, sb)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    of_a, of_b = (
        sketches.select(F.col("uid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"
    )
    both = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by the exact size of their intersection."""
    of_a = tokens.select(F.col("uid").alias("a"), F.col("tokens").alias("ta"))
    of_b = tokens.select(F.col("uid").alias("b"), F.col("tokens").alias("tb"))
    whole = pairs.join(of_a, "a").join(of_b, "b")
    na, nb = F.size("ta"), F.size("tb")
    near = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    both = F.size(F.array_intersect("ta", "tb"))
    return whole.where(near & (both * 100 >= (na + nb - both) * percent)).select("a", "b")


def _pairs_in_lists(rows: DataFrame) -> DataFrame:
    """Pairs of the views listed for each key, of which one at least stands there whole.

    `views` is a list of 2 * view + (1 for a deletion), `comps` the components; the lists are
    bounded by the hot limit. Pairs within a component are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            found = []
            for entries in batch.column(0).to_pylist():
                view = np.array([e["v"] for e in entries])
                comp = np.array([e["comp"] for e in entries])
                i, j = np.triu_indices(len(view), 1)
                good = (comp[i] != comp[j]) & ((view[i] & view[j] & 1) == 0)
                if good.any():
                    a, b = view[i[good]] >> 2, view[j[good]] >> 2
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            if found:
                pair = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _segments_of(view: int, held: pa.Scalar, lone: pa.Scalar, bands: Bands):
    """(segment, key, whole, live, gain) of a short view's segments and their one-deletions.

    A key is live unless it holds a lone shingle, as then no other short view can have it. gain is 2 for
    a segment of several shingles, as its neighbourhood counts too, else 1; but no less than the lone
    shingles of the segment, as each adds one to the distance of every pair.
    """
    tokens = held.values.to_numpy().view(np.uint64)
    band, m, _ = bands.views(len(tokens))[view & 1]
    segment, key = occupied(tokens, band, m)
    near, near_key = deletions(tokens, band, m)
    where = segment_of(tokens, band, m)
    alone = np.isin(tokens, lone.values.to_numpy().view(np.uint64))
    lones = np.bincount(where[alone], minlength=m)
    dropped = alone[np.bincount(where, minlength=m)[where] > 1].astype(np.int64)
    # sets may also agree on a segment that is empty in both
    empty = np.setdiff1d(np.arange(m), segment)
    segment = np.r_[segment, empty]
    key = np.r_[key, segment_key(np.zeros(len(empty), np.uint64), empty, band)]
    gain = np.ones(m, np.int64)
    gain[near] = 2
    whole = np.r_[np.ones(len(segment), bool), np.zeros(len(near), bool)]
    live = np.r_[lones[segment] == 0, lones[near] == dropped]
    segment = np.r_[segment, near]
    return segment, np.r_[key, near_key].view(np.int64), whole, live, np.maximum(gain, lones)


def _in_segments(chosen: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Which keys lie in a segment of the chosen ones."""
    held = np.zeros(segment.max() + 1, bool)
    held[segment[chosen]] = True
    return held[segment]


def _short_keys(short: DataFrame, percent: int, choose) -> DataFrame:
    """(key, view, comp, segment, whole) of short views (view, comp, tokens, lone).

    `choose` tells which of a view's live keys are wanted by (segment, key, whole).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in pieces(batches, 32):
            made = [[], [], [], [], []]
            views, comps = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for view, comp, held, lone in zip(views, comps, batch.column(2), batch.column(3)):
                segment, key, whole, live, _ = _segments_of(view, held, lone, bands)
                segment, key, whole = segment[live], key[live], whole[live]
                if len(key):
                    at = np.flatnonzero(choose(segment, key, whole))
                    own = (key[at], np.full(len(at), view), np.full(len(at), comp), segment[at], whole[at])
                    for column, values in zip(made, own):
                        column.append(values)
            if made[0]:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(column), kind) for column, kind in zip(made, kinds)],
                    names=["key", "view", "comp", "segment", "whole"],
                )

    schema = "key long, view long, comp long, segment int, whole boolean"
    return short.select("view", "comp", "tokens", "lone").mapInArrow(run, schema)


def _holes(reps: DataFrame, percent: int, wanted) -> DataFrame:
    """The wanted keys of the one-deletions of some segments (list `of` of their keys) of views (view, tokens, lone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in pieces(batches, 256):
            found = [np.empty(0, np.int64)]
            for view, held, lone, of in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                segment, key, whole, live, _ = _segments_of(view, held, lone, bands)
                own = live & whole & np.isin(key, of.values.to_numpy())
                found.append(key[_in_segments(own, segment) & ~whole & wanted(key)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["key"])

    return reps.select("view", "tokens", "lone", "of").mapInArrow(run, "key long")


def _missing_units(short: DataFrame, percent: int, dear) -> DataFrame:
    """(view, missing) of the short views (view, need, tokens, lone) that keys below the limit don't cover.

    A segment counts nothing if its own key is dear, once if one of its neighbourhood is, else fully.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in pieces(batches, 256):
            views, missing = [], []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:])
            for view, need, held, lone in rows:
                segment, key, whole, live, units = _segments_of(view, held, lone, bands)
                costly = live & dear(key)
                units[segment[costly & ~whole]] = 1
                units[segment[costly & whole]] = 0
                if units.sum() < need:
                    views.append(view)
                    missing.append(need - int(units.sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(views, pa.int64()), pa.array(missing, pa.int64())], names=["view", "missing"]
            )

    return short.select("view", "need", "tokens", "lone").mapInArrow(run, "view long, missing long")


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    hot: int = HOT,
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs.

    Two texts link when 100 * intersection >= percent * union of their sets of `words`-word shingles.
    """
    index = settle(_index(docs, id_col, text_col, words, percent))
    index = index.withColumn("uid", F.monotonically_increasing_id())  # rows are on disk: stable
    classes = settle(index.where("n > 0").groupBy("k1", "k2").agg(F.min("uid").alias("rep")))
    members = index.select("uid", "id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left")
    # rows with the keys of their views stay where they are: only ids that may be copies are looked up
    copies = members.where("rep is not null and uid <> rep").select(F.col("uid").alias("copy"))
    copies = settle(copies)
    maybe = MemberFilter(copies).may_hold(F.col("uid"))
    keyed = index.where(F.size("needs") > 0)
    reps = keyed.where(~maybe).unionByName(
        keyed.where(maybe).join(copies, F.col("uid") == F.col("copy"), "left_anti")
    )
    costs = (
        _shared_keys(reps)
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("cost"), F.min("view").alias("first"))
        .where("cost > 1")
    )
    costs = settle(costs)
    # nearly every key occurs once: the others are known now, and only these are shuffled
    shared = settle(_shared_keys(reps, MemberFilter(costs.select("key")).asker()).join(costs, "key"))

    needs = reps.select("uid", F.posexplode(F.arrays_zip("keys", "needs")).alias("role", "of")).select(
        (F.col("uid") * 2 + F.col("role")).alias("view"), "uid",
        F.size("of.keys").alias("n_keys"), F.col("of.needs").alias("need"),
    )
    lost = shared.where(F.col("cost") > hot).groupBy("view").agg(F.count(F.lit(1)).alias("lost"))
    short = settle(
        needs.join(lost, "view", "left")
        .where(F.col("n_keys") - F.coalesce("lost", F.lit(0)) < F.col("need"))
        .select("view", "uid", "need")
    )
    met = shared.select(F.shiftright("view", 1).alias("uid")).unionByName(short.select("uid")).distinct()
    wanted = settle(reps.join(met, "uid", "left_semi").select("uid", "id", "k1", "n", "sketch"))

    def tokens_of(uids: DataFrame) -> DataFrame:
        chosen = settle(wanted.select("uid", "id", "k1").join(uids.distinct(), "uid", "left_semi"))
        return settle(_token_rows(docs, chosen, id_col, text_col, words))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid")))

    # every key links its members with its first one
    stars = shared.select(
        F.shiftright("first", 1).alias("a"), F.shiftright("view", 1).alias("b")
    ).where("a <> b").distinct()
    stars = settle(_likely(settle(stars), wanted, percent))
    tokens = tokens_of(ends(stars).unionByName(short.select("uid")))
    links = settle(_verified(stars, tokens, percent))
    known = components(links)

    def placed(rows: DataFrame) -> DataFrame:
        """Rows with the component of their view's class."""
        of = known.select(F.col("node").alias("uid"), F.col("root").alias("root"))
        uid = F.shiftright("view", 1)
        return (
            rows.withColumn("uid", uid).join(of, "uid", "left")
            .withColumn("comp", F.coalesce("root", "uid")).drop("root", "uid")
        )

    def across(rows: DataFrame) -> DataFrame:
        """Pairs across components within keys of bounded cost; rows have key, view, whole, comp."""
        item = F.struct((F.col("view") * 2 + F.when(F.col("whole"), 0).otherwise(1)).alias("v"), "comp")
        lists = (
            rows.groupBy("key")
            .agg(F.collect_list(item).alias("views"), F.min("comp").alias("low"), F.max("comp").alias("high"))
            .where("low < high")
        )
        return _pairs_in_lists(lists.select("views"))

    cold = placed(shared.where(F.col("cost") <= hot).withColumn("whole", F.lit(True)))
    found = [across(cold)]
    more_links = None
    if short.take(1):
        more, more_links = _short_pairs(short, tokens, placed, across, percent, hot, block)
        found += more
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = settle(_likely(settle(pairs.where("a <> b").distinct()), wanted, percent))
    if pairs.take(1):
        verified = _verified(pairs, tokens_of(ends(pairs)), percent)
        more_links = verified if more_links is None else verified.unionByName(more_links)
    more_links = pairs if more_links is None else settle(more_links)
    # whole components move: links join the roots of the first step
    roots = components(
        links.unionByName(more_links)
    ) if more_links.take(1) else known

    grouped = members.join(
        roots.select(F.col("node").alias("rep"), "root"), "rep", "left"
    ).select("id", "n", F.coalesce("root", "rep").alias("root"))
    grouped = settle(grouped)
    lowest = settle(
        grouped.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    )
    linked_rows = grouped.where("root is not null").join(lowest, "root").select("id", "n", "component_id")
    alone = grouped.where("root is null").select("id", "n", F.col("id").alias("component_id"))
    return linked_rows.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"
    )


def _short_pairs(short, tokens, placed, across, percent: int, hot: int, block: int):
    """Of short views the pairs over one-deletion neighbourhoods and the links over dear keys, if any.

    A shingle that no other short class has is lone: it adds one to the distance of every such pair, so a
    view with as many of these as it needs units has no short partner and takes no further part, and
    keys that hold one are not made at all.
    """
    tokens = settle(tokens.join(short.select("uid").distinct(), "uid", "left_semi"))
    lone = (
        tokens.select("uid", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"))
        .where("n = 1")
        .groupBy("uid")
        .agg(F.collect_list("token").alias("lone"))
    )
    short = settle(
        short.join(lone, "uid", "left")
        .withColumn("lone", F.coalesce("lone", F.array().cast("array<long>")))
        .where(F.size("lone") < F.col("need"))
        .select("view", "uid", "need", "lone")
    )
    whole = settle(placed(short).join(tokens.withColumnRenamed("uid", "of"), F.shiftright("view", 1) == F.col("of"))
                   .select("view", "need", "comp", "tokens", "lone"))
    # all neighbours of a dear segment are dear, as all its views have them: one view tells them for all,
    # and the others make neighbourhoods of their other segments only
    # (a filter may take a few cheap keys for steep or dear: all that follows goes by the filters)
    own = settle(
        _short_keys(whole, percent, lambda segment, key, whole: whole)
        .groupBy("key").agg(F.count(F.lit(1)).alias("cost"), F.min("view").alias("view"))
    )
    steep = MemberFilter(own.where(F.col("cost") > 2 * hot).select("key"))
    steep_keys = settle(own.where(steep.may_hold(F.col("key"))).select("key", "view"))
    reps = steep_keys.groupBy("view").agg(F.collect_list("key").alias("of"))
    is_steep = steep.asker()

    # neighbours that no view has whole meet nothing that the units count
    is_whole = MemberFilter(own.select("key")).asker()

    def not_steep(segment: np.ndarray, key: np.ndarray, whole: np.ndarray) -> np.ndarray:
        known = is_steep(key)
        return ~whole & ~known & is_whole(key) & ~_in_segments(whole & known, segment)

    costs = settle(
        _short_keys(whole, percent, not_steep).groupBy("key").agg(F.count(F.lit(1)).alias("cost"))
        .unionByName(own.select("key", "cost"))
        .groupBy("key").agg(F.sum("cost").alias("cost"))
        .where("cost > 1")
    )
    dear_keys = settle(
        costs.where(F.col("cost") > 2 * hot).select("key").unionByName(steep_keys.select("key"))
        .unionByName(_holes(reps.join(whole, "view"), percent, is_whole)).distinct()
    )
    dear = MemberFilter(dear_keys).asker()
    met = MemberFilter(costs.where(F.col("cost") <= 2 * hot).select("key")).asker()
    found = [across(_short_keys(whole, percent, lambda segment, key, whole: met(key) & ~dear(key)))]
    still = settle(_missing_units(whole, percent, dear))
    if not still.take(1):
        return found, None

    # a dear segment is asked over its own key, others over those of their neighbours that are dear:
    # one unit each, as the segment itself has counted once where only a neighbour is dear
    def dear_ones(segment: np.ndarray, key: np.ndarray, whole: np.ndarray) -> np.ndarray:
        costly = dear(key)
        return costly & (whole | ~_in_segments(costly & whole, segment))

    left = settle(_short_keys(whole.join(still.select("view"), "view", "left_semi"), percent, dear_ones))
    mixed = settle(
        left.groupBy("key")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("cost"),
             F.min(F.xxhash64("view")).alias("group"))
        .where("low < high")
        .select("key", "cost", "group")
    )
    left = settle(left.join(mixed, "key", "left"))
    # allocation: a view asks over its cheapest segments until it has the units that it needs;
    # segments whose keys hold one component only cost nothing and ask nothing
    prices = left.groupBy("view", "segment").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("price"))
    order = Window.partitionBy("view").orderBy("price", "segment")
    asked = (
        prices.withColumn("number", F.row_number().over(order)).join(still, "view")
        .where(F.col("number") <= F.col("missing")).select("view", "segment")
    )
    # two keys are in one group with the probability that a view of either is one of both, so keys of much
    # the same views, such as the segments of a common passage, meet once, and others rarely
    rows = left.where("group is not null").withColumn("key", F.col("group"))
    ask = settle(rows.join(asked, ["view", "segment"], "left_semi").select("key", "view").distinct())
    told = settle(rows.where("whole").select("key", "view").distinct())
    merged = _merged_groups(told)

    def regrouped(rows: DataFrame) -> DataFrame:
        both = rows.join(merged, "key", "left")
        return settle(both.select(F.coalesce("target", "key").alias("key"), "view").distinct())

    return found, _linked_over_dear_keys(regrouped(ask), regrouped(told), whole, percent, block)


def _merged_groups(told: DataFrame) -> DataFrame:
    """(key, target) of the groups (key, view) that join another one that holds at least half of their views.

    The target is the largest group of those views and at most twice as large, so a merged group sends fewer
    rows than its parts, and no small group has to meet a much larger one.
    """
    sized = told.join(told.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    best = F.max(F.struct("n", F.col("key").alias("target"))).over(Window.partitionBy("view"))
    placed = sized.withColumn("best", best)
    shares = placed.groupBy("key", "n", "best").agg(F.count(F.lit(1)).alias("held"))
    first = shares.groupBy("key", "n").agg(F.max(F.struct("held", "best")).alias("first"))
    return settle(
        first.select("key", "n", "first.held", F.col("first.best.n").alias("size"), "first.best.target")
        .where("target <> key and 2 * held >= n and 2 * n >= size").select("key", "target")
    )


def _linked_over_dear_keys(ask: DataFrame, told: DataFrame, whole: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between views that ask over a group of dear keys and all that it holds, compared inside tasks.

    `key` is the group. Its askers are dealt into slices, its views into blocks, and every slice meets every
    block; a task compares one slice with one block and hands on a spanning forest of the links it finds.
    Sketches are compared first, and whole sets only of views that may be linked in that slice and block.
    """
    # blocks and slices are bounded by views and by their tokens, so long texts come in smaller ones
    weighed = told.withColumn("asks", F.lit(False)).unionByName(ask.withColumn("asks", F.lit(True))).join(
        whole.select("view", F.size("tokens").alias("size")), "view"
    )
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / TOKENS_IN_BLOCK))
    parted = weighed.groupBy("key", "asks").agg(parts.alias("parts"))
    sizes = settle(
        parted.groupBy("key").agg(
            F.max(F.when(~F.col("asks"), F.col("parts"))).alias("blocks"),
            F.max(F.when(F.col("asks"), F.col("parts"))).alias("slices"),
        ).where("slices is not null")
    )
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = lambda count: F.pmod(F.xxhash64("view"), F.col(count))
    askers = ask.join(sizes, "key").select(
        "key", "view", F.lit(True).alias("asks"), own("slices").alias("slice"), numbers("blocks").alias("block")
    )
    held = told.join(sizes, "key").select(
        "key", "view", F.lit(False).alias("asks"), own("blocks").alias("block"), numbers("slices").alias("slice")
    )
    # sketches go to every block; tokens only where a sketch of the block leaves a link possible
    drawn = _drawn(whole)
    cells = askers.unionByName(held).join(drawn, "view")
    near = settle(_near_in_cells(cells, percent))
    rows = near.join(whole.select("view", "comp", "tokens"), "view")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).combine_chunks()
        asks = column("asks").to_numpy(zero_copy_only=False)
        uid = column("view").to_numpy(zero_copy_only=False) >> 1
        comp = column("comp").to_numpy(zero_copy_only=False)
        lists = column("tokens")
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        both = common(lists, size, asks)
        n = size[asks][:, None] + size[~asks][None, :]
        linked = (both * 100 >= (n - both) * percent) & (comp[asks][:, None] != comp[~asks][None, :])
        i, j = np.nonzero(linked)
        a, b = forest(uid[asks][i], uid[~asks][j])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return rows.groupBy("key", "slice", "block").applyInArrow(run, "a long, b long")


def _drawn(whole: DataFrame) -> DataFrame:
    """(view, comp, size, sketch) of views (view, comp, tokens), with sketches of twice the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            lists = batch.column(2)
            sketches = [sketch(held.values.to_numpy().view(np.uint64), 2) for held in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists.value_lengths(), pa.array(sketches, pa.binary())],
                names=["view", "comp", "size", "sketch"],
            )

    schema = "view long, comp long, size int, sketch binary"
    return whole.select("view", "comp", "tokens").mapInArrow(run, schema)


def _near_in_cells(cells: DataFrame, percent: int) -> DataFrame:
    """(key, slice, block, view, asks) of the rows that may be linked with one of the other side of their cell,
    across components, by what the sketches tell; none that is gets lost."""

    def run(cell: tuple, table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        asks, comp, size = column("asks"), column("comp"), column("size").astype(np.int64)
        sketches = table.column("sketch").to_pylist()
        width = np.array([len(s) for s in sketches])
        near = np.zeros(len(asks), bool)
        for wide in np.unique(width[asks]):
            for other in np.unique(width[~asks]):
                a = np.flatnonzero(asks & (width == wide))
                b = np.flatnonzero(~asks & (width == other))
                words = min(wide, other) // 8
                of_a, of_b = (_words([sketches[k] for k in at], words) for at in (a, b))
                apart = np.zeros((len(a), len(b)), np.int32)
                for k in range(words):
                    apart += np.bitwise_count(of_a[:, k][:, None] ^ of_b[:, k][None, :])
                m, n = size[a][:, None], size[b][None, :]
                maybe = np.minimum(m, n) * 100 >= np.maximum(m, n) * percent
                maybe &= apart <= (m + n) * (100 - percent) // (100 + percent)
                maybe &= comp[a][:, None] != comp[b][None, :]
                near[a] |= maybe.any(axis=1)
                near[b] |= maybe.any(axis=0)
        return table.select(["key", "slice", "block", "view", "asks"]).filter(pa.array(near))

    schema = "key long, slice long, block long, view long, asks boolean"
    cells = cells.withColumns({name: F.col(name).cast("long") for name in ("slice", "block")})
    return cells.groupBy("key", "slice", "block").applyInArrow(run, schema)


def _words(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of one width, folded to so many words of 64 bits; one row each."""
    folded = np.frombuffer(b"".join(sketches), "<u8").reshape(len(sketches), -1)
    while folded.shape[1] > words:
        half = folded.shape[1] // 2
        folded = folded[:, :half] ^ folded[:, half:]
    return folded


def common(lists: pa.Array, size: np.ndarray, side: np.ndarray) -> np.ndarray:
    """How many tokens the sets of one side share with each set of the other.

    Tokens in few pairs of sets are counted pair by pair, the others as a product of matrices.
    """
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    place = np.where(side, np.cumsum(side) - 1, np.cumsum(~side) - 1)
    tokens, token = np.unique(flat, return_inverse=True)
    of_side = side[row]
    there = [np.bincount(token[of_side == s], minlength=len(tokens)) for s in (True, False)]
    pairs = there[0] * there[1]
    total = np.zeros((int(side.sum()), int((~side).sum())), np.float32)
    rare = (pairs > 0) & (pairs <= RARE_PAIRS)
    order = np.argsort(token, kind="stable")
    order = order[rare[token[order]]]
    ones, others = order[of_side[order]], order[~of_side[order]]
    low = np.searchsorted(token[others], token[ones], "left")
    count = np.searchsorted(token[others], token[ones], "right") - low
    first = np.repeat(ones, count)
    second = others[np.repeat(low, count) + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)]
    np.add.at(total, (place[row[first]], place[row[second]]), 1)
    often = np.flatnonzero(pairs > RARE_PAIRS)
    number = np.full(len(tokens), -1)
    for at in range(0, len(often), TOKENS_AT_ONCE):
        some = often[at : at + TOKENS_AT_ONCE]
        number[:] = -1
        number[some] = np.arange(len(some))
        mats = []
        for s in (True, False):
            own = np.flatnonzero((of_side == s) & (number[token] >= 0))
            mat = np.zeros((int((side == s).sum()), len(some)), np.float32)
            mat[place[row[own]], number[token[own]]] = 1
            mats.append(mat)
        total += mats[0] @ mats[1].T
    return total.astype(np.int64)


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each group of similar ones, the one with the smallest id.

    Rows go by id and hash of the text, so null and repeated ids stand for nobody else; null ids
    come last, and among equal ids the hash decides. Rows that repeat in both are one document.
    """
    (key,) = fresh(docs.columns, "row_key")
    own = F.col(f"`{id_col}`")
    keyed = docs.withColumn(
        key,
        F.struct(own.isNull().alias("none"), own.alias("id"), F.xxhash64(f"`{text_col}`").alias("mark")),
    )
    found = settle(similar_groups(keyed, key, text_col, **options))
    extra = found.where(~F.col(key).eqNullSafe(F.col("component_id")))
    kept = drop_ids(keyed, settle(extra.select(key).distinct()), key)
    repeated = (
        found.where((F.col("n_shingles") > 0) & F.col(key).eqNullSafe(F.col("component_id")))
        .groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    )
    repeated = settle(repeated)
    if repeated.take(1):
        again = MemberFilter(repeated.select(F.xxhash64(key).alias("hash"))).may_hold(F.xxhash64(key))
        # a filter may take single rows for repeated ones, and texts without shingles always stay
        told = repeated.select(F.col(key).alias("twice"))
        checked = kept.where(again).join(told, F.col(key).eqNullSafe(F.col("twice")), "left")
        single = checked.where("twice is null").drop("twice")
        one = checked.where("twice is not null").drop("twice").dropDuplicates([key])
        kept = kept.where(~again).unionByName(single).unionByName(one)
    return kept.drop(key)
