"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to owners by document frequency, the rarest first. Items travel in
bundles: a bundle carries sparse accumulators (item, document, score so far) from owner to owner. At
each one it is cogrouped with the owner's postings, slice of documents by slice, and the integer
contributions of the owner's terms are added. After the last owner the best documents of each item
are selected.

Accumulators stay sparse without loss. The k-th best sum of an item so far is a lower bound of its
final k-th score. A document whose sum and the greatest contributions that the later owners can
still add (by term and class of document length, over all documents) stay below it is dropped; where
those alone stay below it, an owner adds to accumulators that exist and makes no new ones, and only
postings of documents that some bundle carries are dealt out. Equality never drops anything, so
ties are decided at the end, by score and then by id.

Items go in blocks of `ITEMS_AT_ONCE` and of bounded bytes of terms, so what the driver and tasks
hold of them does not grow with their number; statistics cover all documents.

Defined results: a null or empty text, or one without terms, is no document and asks for nothing;
rows that repeat are separate documents and separate items; among equal scores null ids come last;
an item without a document of positive score has no row; empty tables give empty results; other
columns are not read, so their names do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.llm.bloom import MemberFilter
from citewerk.llm.shared import pieces, raw_texts, settle, written

ITEMS_AT_ONCE = 1024
TERM_BYTES_AT_ONCE = 1 << 24
ITEMS_IN_BUNDLE = 256
DOCS_IN_SLICE = 4096
#: Owners by share of the documents that hold a term: up to a 256th, a 64th, ...
SHARES = (1 / 256, 1 / 64, 1 / 16, 1 / 8, 1 / 4, 1.0)
#: Classes of document length, by number of binary digits.
CLASSES = 14
TEXT_BLOCK = 1 << 20

#: Digits, letters and all bytes above 7F make terms; A-Z become a-z.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + TEXT_BLOCK
        while end < len(text) and _TERM_BYTES[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_TERM_BYTES).split()
        at = end


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, terms) of every row: its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            found = [sorted({t for part in term_lists(text) for t in part}) for text in raw_texts(batch.column(2))]
            terms = pa.array(found, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms], names=["item", "item_id", "terms"])

    schema = T.StructType().add("item", T.LongType()).add("item_id", items.schema[id_col].dataType)
    schema = schema.add("terms", T.ArrayType(T.BinaryType()))
    rows = items.select(
        F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("item_id"),
        F.col(f"`{text_col}`").alias("text"),
    )
    return settle(rows.mapInArrow(run, schema).where(F.size("terms") > 0))


def term_counts(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """(uid, id, n, terms, tfs) of every document: its length and its counts of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for batch in pieces(batches, 512):
            rows = []
            for text in raw_texts(batch.column(2)):
                found, size = [], 0
                for part in term_lists(text):
                    numbers = np.fromiter(map(get, part, repeat(-1)), np.int32, len(part))
                    found.append(numbers[numbers >= 0])
                    size += len(part)
                terms, tfs = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
                rows.append((size, terms, tfs))
            sizes, terms, tfs = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["uid", "id", "n", "terms", "tfs"],
            )

    schema = T.StructType().add("uid", T.LongType()).add("id", docs.schema[id_col].dataType).add("n", T.LongType())
    schema = schema.add("terms", T.ArrayType(T.IntegerType())).add("tfs", T.ArrayType(T.LongType()))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
    )
    return settle(rows.mapInArrow(run, schema).where("n > 0"))


def damping(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with n terms; split so that no product outgrows 64 bits early."""
    whole, rest = divmod(90 * docs, total)
    return 10 + n * whole + n * rest // total


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), CLASSES - 1)


def _lists(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values) of a list column."""
    held = batch.column(column)
    sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), sizes), held.flatten().to_numpy(zero_copy_only=False)


def term_statistics(counts: DataFrame, docs: int, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """df of every term and its greatest impact in each class of length, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, top = np.zeros((size, CLASSES), np.int64), np.zeros((size, CLASSES), np.int64)
        for batch in pieces(batches, 4096):
            row, term = _lists(batch, 1)
            _, tf = _lists(batch, 2)
            n = batch.column(0).to_numpy(zero_copy_only=False)
            kind = length_class(n)[row]
            np.add.at(df, (term, kind), 1)
            np.maximum.at(top, (term, kind), impact(tf, damping(n, docs, total)[row]))
        term, kind = np.nonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(term.astype(np.int32)), pa.array(kind.astype(np.int32)),
             pa.array(df[term, kind]), pa.array(top[term, kind])],
            names=["term", "kind", "df", "top"],
        )

    rows = counts.select("n", "terms", "tfs").mapInArrow(run, "term int, kind int, df long, top long")
    sums = rows.groupBy("term", "kind").agg(F.sum("df").alias("df"), F.max("top").alias("top"))
    df, top = np.zeros(size, np.int64), np.zeros((size, CLASSES), np.int64)
    for row in sums.collect():  # terms of one block of items x classes
        df[row.term] += row.df
        top[row.term, row.kind] = row.top
    return df, top


@dataclass
class Bundles:
    """What tasks know of one block of items: terms, weights and owners, and the items that ask for them."""

    owner: np.ndarray  # of each term; -1: adds nothing
    weights: np.ndarray
    asking: list[np.ndarray]  # items of each term
    rest: np.ndarray  # owners + 1, items, classes: the most that this and later owners add
    size: int  # items in a bundle

    @property
    def items(self) -> int:
        return self.rest.shape[1]

    def bundles_of(self, term: int) -> np.ndarray:
        return np.unique(self.asking[term] // self.size)


def bundled(terms: list[list[int]], df: np.ndarray, top: np.ndarray, docs: int, size: int) -> Bundles:
    limits = np.array([share * docs for share in SHARES])
    owner = np.minimum(np.searchsorted(limits, df, "left"), len(SHARES) - 1)
    weights = np.array([weight(docs, int(d)) for d in df], np.int64)
    owner[(df == 0) | (weights <= 0)] = -1
    asking: list[list[int]] = [[] for _ in df]
    rest = np.zeros((len(SHARES) + 1, len(terms), CLASSES), np.int64)
    for item, own in enumerate(terms):
        for term in own:
            if owner[term] >= 0:
                asking[term].append(item)
                rest[: owner[term] + 1, item] += weights[term] * top[term]
    return Bundles(owner, weights, [np.array(a, np.int64) for a in asking], rest, size)


_POSTINGS = "owner int, slice long, uid long, kind int, terms array<int>, impacts array<long>"
_CARRIED = "bundle int, slice long, item int, uid long, kind int, score long"


def owned_postings(counts: DataFrame, known, docs: int, total: int, slices: int) -> DataFrame:
    """Each document's postings apart for each owner: the term-partitioned index of this block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = known.value.owner
        for batch in pieces(batches, 4096):
            row, term = _lists(batch, 3)
            _, tf = _lists(batch, 4)
            part, uid, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            gain = impact(tf, damping(n, docs, total)[row])
            of = owner[term]
            used = of >= 0
            order = np.lexsort((row[used], of[used]))
            row, term, gain, of = (x[used][order] for x in (row, term, gain, of))
            if not len(row):
                continue
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (of[1:] != of[:-1])])
            ends = pa.array(np.r_[first, len(row)].astype(np.int32))
            at = row[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[first].astype(np.int32)), pa.array(part[at]), pa.array(uid[at]),
                 pa.array(length_class(n)[at].astype(np.int32)),
                 pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(gain))],
                names=["owner", "slice", "uid", "kind", "terms", "impacts"],
            )

    # ids are dense within a task only, so slices go by their hash
    slice_of = F.pmod(F.xxhash64("uid"), F.lit(slices)).cast("long").alias("slice")
    return counts.select(slice_of, "uid", "n", "terms", "tfs").mapInArrow(run, _POSTINGS)


def _dealt(postings: DataFrame, known, number: int, floor: np.ndarray, carried) -> DataFrame:
    """Postings of an owner for each bundle that asks for them.

    A document goes where one of its terms may still bring it into some list, or if some bundle
    carries it (`carried` is a test for uids).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = known.value
        may = info.rest[number] >= floor[:, None]
        count = -(-info.items // info.size)
        asks = np.zeros((count, len(info.owner)), bool)
        opens = np.zeros((count, len(info.owner), CLASSES), bool)
        for term in np.flatnonzero(info.owner == number):
            for bundle in info.bundles_of(term):
                asks[bundle, term] = True
                own = info.asking[term]
                opens[bundle, term] = may[own[own // info.size == bundle]].any(axis=0)
        for batch in pieces(batches, 4096):
            row, term = _lists(batch, 3)
            _, gain = _lists(batch, 4)
            kind = batch.column(2).to_numpy(zero_copy_only=False)[row]
            live = np.zeros(batch.num_rows, bool)
            if carried is not None and batch.num_rows:
                live = carried(batch.column(1).to_numpy(zero_copy_only=False))
            for bundle in range(count):
                wanted = np.zeros(batch.num_rows, bool)
                wanted[row[opens[bundle, term, kind]]] = True
                at = np.flatnonzero(asks[bundle, term] & (wanted | live)[row])
                if not len(at):
                    continue
                of, first = np.unique(row[at], return_index=True)
                ends = pa.array(np.r_[first, len(at)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(of), bundle, np.int32)), *(batch.column(c).take(pa.array(of)) for c in (0, 1, 2)),
                     pa.ListArray.from_arrays(ends, pa.array(term[at])),
                     pa.ListArray.from_arrays(ends, pa.array(gain[at]))],
                    names=["bundle", "slice", "uid", "kind", "terms", "impacts"],
                )

    rows = postings.where(F.col("owner") == number).select("slice", "uid", "kind", "terms", "impacts")
    return rows.mapInArrow(run, _POSTINGS.replace("owner", "bundle"))


def _kept(carried: DataFrame, known, number: int, floor: np.ndarray) -> DataFrame:
    """Accumulators that owners from `number` on can still bring up to the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = known.value.rest[number]
        for batch in batches:
            item = batch.column(2).to_numpy(zero_copy_only=False)
            kind = batch.column(4).to_numpy(zero_copy_only=False)
            score = batch.column(5).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(score + rest[item, kind] >= floor[item]))

    return carried.mapInArrow(run, _CARRIED)


def _add(known, number: int, floor: np.ndarray, k: int):
    """What an owner does with one bundle in one slice of the documents."""

    def run(key: tuple, carried: pa.Table, postings: pa.Table) -> pa.Table:
        info = known.value
        bundle, part = key[0].as_py(), key[1].as_py()
        low = bundle * info.size
        size = min(info.size, info.items - low)
        numbers = lambda table, name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        uids = np.concatenate([numbers(carried, "uid"), numbers(postings, "uid")])
        uid, first, at = np.unique(uids, return_index=True, return_inverse=True)
        kind = np.concatenate([numbers(carried, "kind"), numbers(postings, "kind")])[first]
        score = np.zeros((size, len(uid)), np.int64)
        there = np.zeros((size, len(uid)), bool)
        item = numbers(carried, "item") - low
        score[item, at[: len(item)]] = numbers(carried, "score")
        there[item, at[: len(item)]] = True
        may = (info.rest[number] >= floor[:, None])[low : low + size]
        doc = at[len(item) :]
        lists = postings.column("terms").combine_chunks()
        row = np.repeat(doc, lists.value_lengths().to_numpy(zero_copy_only=False))
        term = lists.flatten().to_numpy(zero_copy_only=False)
        gain = postings.column("impacts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        row, term, gain = row[order], term[order], gain[order]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        for start, end in zip(starts, np.r_[starts[1:], len(term)]):
            of, own = term[start], row[start:end]
            asking = info.asking[of]
            asking = asking[(asking >= low) & (asking < low + size)] - low
            score[np.ix_(asking, own)] += info.weights[of] * gain[start:end]
            there[np.ix_(asking, own)] |= may[np.ix_(asking, kind[own])]
        there &= score > 0
        bound = floor[low : low + size].copy()
        if len(uid) >= k:  # the k-th best here is a lower bound, too
            best = np.partition(np.where(there, score, 0), len(uid) - k, axis=1)[:, len(uid) - k]
            bound = np.maximum(bound, best)
        there &= score + info.rest[number + 1][low : low + size][:, kind] >= bound[:, None]
        i, d = np.nonzero(there)
        return pa.table(
            {"bundle": pa.array(np.full(len(i), bundle, np.int32)), "slice": pa.array(np.full(len(i), part, np.int64)),
             "item": pa.array((i + low).astype(np.int32)), "uid": pa.array(uid[d]),
             "kind": pa.array(kind[d].astype(np.int32)), "score": pa.array(score[i, d])}
        )

    return run


def _floor(carried: DataFrame, items: int, k: int) -> np.ndarray:
    """The k-th best sum of every item so far; 1 where it has fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, score = np.empty(0, np.int32), np.empty(0, np.int64)
        for batch in batches:
            item = np.concatenate([item, batch.column(0).to_numpy(zero_copy_only=False)])
            score = np.concatenate([score, batch.column(1).to_numpy(zero_copy_only=False)])
            order = np.lexsort((-score, item))
            item, score = item[order], score[order]
            place = np.arange(len(item)) - np.searchsorted(item, item, "left")
            item, score = item[place < k], score[place < k]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score)], names=["item", "score"])

    best = carried.select("item", "score").mapInArrow(run, "item int, score long")
    part = F.pmod(F.spark_partition_id(), F.lit(64))
    within = Window.partitionBy("item", "part").orderBy(F.desc("score"))
    best = best.withColumn("part", part).withColumn("place", F.row_number().over(within)).where(F.col("place") <= k)
    overall = Window.partitionBy("item").orderBy(F.desc("score"))
    rows = best.withColumn("place", F.row_number().over(overall)).where(F.col("place") == k).select("item", "score")
    floor = np.ones(items, np.int64)
    for row in rows.collect():  # one for each item of a block
        floor[row.item] = row.score
    return floor


def _search(counts: DataFrame, terms: list[list[int]], size: int, docs: int, total: int, k: int,
            bundle: int, slice_docs: int) -> DataFrame:
    """(item, uid, score) of all documents that may be among the k best of each item of one block."""
    spark = counts.sparkSession
    df, top = term_statistics(counts, docs, total, size)
    known = spark.sparkContext.broadcast(bundled(terms, df, top, docs, bundle))
    slices = max(1, -(-docs // slice_docs))
    postings = written(owned_postings(counts, known, docs, total, slices), "postings", by="owner")
    floor = np.ones(len(terms), np.int64)
    carried = None
    for number in range(len(SHARES)):
        if carried is None:
            before, asked = spark.createDataFrame([], _CARRIED), None
        else:
            before = settle(_kept(carried, known, number, floor))
            asked = MemberFilter(before.select("uid")).asker()
        dealt = _dealt(postings, known, number, floor, asked)
        met = before.groupBy("bundle", "slice").cogroup(dealt.groupBy("bundle", "slice"))
        carried = settle(met.applyInArrow(_add(known, number, floor, k), _CARRIED))
        floor = np.maximum(floor, _floor(carried, len(terms), k))
    return _kept(carried, known, len(SHARES), floor).select("item", "uid", "score")


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    k: int = 10,
    items_at_once: int = ITEMS_AT_ONCE,
    bundle: int = ITEMS_IN_BUNDLE,
    slice_docs: int = DOCS_IN_SLICE,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score for each item."""
    spark = docs.sparkSession
    asked = item_terms(items, item_id, text_col)
    size = asked.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t))).alias("bytes"),
    ).first()
    blocks = max(-(-size.n // items_at_once), -(-(size.bytes or 0) // TERM_BYTES_AT_ONCE))
    schema = T.StructType().add("item_id", items.schema[item_id].dataType).add("rank", T.IntegerType())
    schema = schema.add("doc_id", docs.schema[doc_id].dataType).add("score", T.LongType())
    found = None
    for number in range(blocks):
        own = asked.where(F.abs(F.xxhash64("item") % blocks) == number).orderBy("item").collect()
        if not own:
            continue
        numbers: dict[bytes, int] = {}
        terms = [[numbers.setdefault(bytes(t), len(numbers)) for t in row.terms] for row in own]
        counts = term_counts(docs, doc_id, text_col, spark.sparkContext.broadcast(numbers))
        whole = counts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).first()
        if not whole.docs:
            break
        best = settle(_search(counts, terms, len(numbers), whole.docs, whole.total, k, bundle, slice_docs))
        held = MemberFilter(best.select("uid")).may_hold(F.col("uid"))
        named = best.join(counts.where(held).select("uid", "id"), "uid")
        order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("uid")]
        part = F.pmod(F.xxhash64("uid"), F.lit(64))
        within = Window.partitionBy("item", "part").orderBy(*order)
        overall = Window.partitionBy("item").orderBy(*order)
        first = (
            named.withColumn("part", part).withColumn("place", F.row_number().over(within)).where(F.col("place") <= k)
            .withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= k)
        )
        names = T.StructType().add("item", T.IntegerType()).add("item_id", items.schema[item_id].dataType)
        of = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(own)], names)
        rows = first.join(F.broadcast(of), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        rows = settle(rows)
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], schema)
