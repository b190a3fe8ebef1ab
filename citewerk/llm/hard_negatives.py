"""Hard negatives over an inverted multi-index, exact.

Vectors are whole numbers, floor(scale * component). Each half of the space has a codebook (k-means on
a sample of bounded size), a pair of codes is a cell, and every row is in the cell of its two halves.
A query adds two upper bounds of half scores: the inner product with the centre of a code plus the
norm of its own half times the radius of the code, which is the greatest distance of any row of the
table to that centre. The multi-sequence heap visits the cells in descending order of the sums, so a
list is certified as soon as its last place beats the next sum, and a window also when the sum falls
below its lower end; the rows of what is left cannot be in it.

Rows are range-partitioned by cell, a hot cell over several tasks; each task goes through its rows in
blocks with the anchors of the run (a bounded number of them, run by run), and hands on the best few
rows of each list. Codebooks are fitted on a sample, but every row is indexed and searched.

An anchor's positives are its best other rows of the same label. For each positive, negatives are
the best rows of another label within low/100 to high/100 of its score.

Defined results: rows with a null label, a null vector or a null or non-finite component take no
part; shorter vectors count as filled with zeros; components are held within 2^26 of zero after
scaling, so that products stay within 64 bits; rows that repeat are separate rows, so a copy of the
anchor is an other row; ties go by the smaller id, null ids last; an anchor without positives or a
positive without negatives has no row; an empty table or no anchors give an empty result; names of
other columns do not matter. Ids and labels are whole numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewerk.llm.shared import fresh, pieces, settle

#: Bounds: rows that a codebook is fitted on (about), codes of a half, anchors of one run.
SAMPLE = 20_000
CODES = 32
ANCHORS_AT_ONCE = 2048
LIMIT = 1 << 26
BLOCK_ROWS = 1 << 14
ROWS_IN_TASK, MOST_TASKS = 8192, 1024
#: Rows are scored together, few at first, so that lists fill early and end the search.
FIRST_ROWS, ROWS_TO_SCORE = 32, 2048
NO_ID = np.iinfo(np.int64).max
NOTHING = -(1 << 63) + 1  # its negative fits, too


def whole_vectors(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component (rows x width)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = np.floor(scale * flat)
    return np.clip(out, -LIMIT, LIMIT)


def codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centres by k-means from spread starting points."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)].astype(float)
    for _ in range(rounds):
        nearest = nearest_code(points, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest_code(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


class Index:
    """The two codebooks with their radii."""

    def __init__(self, width: int, centres: list[np.ndarray]):
        self.cut = width // 2
        self.centres = centres
        self.radii = [np.zeros(len(c)) for c in centres]

    def halves(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[:, : self.cut], vectors[:, self.cut :]]

    def bounds(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The greatest half scores that rows of each code can have with these vectors."""
        found = []
        for half, centres, radii in zip(self.halves(vectors), self.centres, self.radii):
            norm = np.linalg.norm(half, axis=1)
            found.append(half @ centres.T + norm[:, None] * radii + 1e-6 * (1 + norm[:, None]))
        return found


def _indexed(rows: DataFrame, index: Index, width: int, scale: int) -> DataFrame:
    """(cell, code1, code2, far1, far2, uid, id, label, vector) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            vectors = whole_vectors(batch.column(3), width, scale)
            codes, far = [], []
            for half, centres in zip(index.halves(vectors), index.centres):
                codes.append(nearest_code(half, centres))
                far.append(np.linalg.norm(half - centres[codes[-1]], axis=1))
            flat = pa.array(vectors.astype(np.int32).ravel())
            ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [pa.array((codes[0] * CODES + codes[1]).astype(np.int32)), *(pa.array(c.astype(np.int32)) for c in codes),
                 *(pa.array(f) for f in far), *(batch.column(c) for c in range(3)),
                 pa.ListArray.from_arrays(ends, flat)],
                names=["cell", "code1", "code2", "far1", "far2", "uid", "id", "label", "vector"],
            )

    kind = "cell int, code1 int, code2 int, far1 double, far2 double, uid long, id long, label long, vector array<int>"
    return rows.select("uid", "id", "label", "vector").mapInArrow(run, kind)


class Block:
    """Rows of some cells in memory: by cell, label and id, with where each label of a cell stands."""

    def __init__(self, code1, code2, uid, ids, label, vectors):
        order = np.lexsort((uid, ids, label, code2, code1))
        self.uid, self.ids, self.label = uid[order], ids[order], label[order]
        self.vectors = vectors[order]
        code1, code2 = code1[order], code2[order]
        cell = code1.astype(np.int64) * CODES + code2
        self.starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.ends = np.r_[self.starts[1:], len(cell)]
        self.place = {int(c): k for k, c in enumerate(cell[self.starts])}
        self.codes = [np.unique(code1), np.unique(code2)]

    def spans(self, cell: int, label: int, same: bool) -> list[tuple[int, int]]:
        """Stretches of a cell's rows that have this label, or any other."""
        k = self.place.get(cell)
        if k is None:
            return []
        low, high = int(self.starts[k]), int(self.ends[k])
        first = low + int(np.searchsorted(self.label[low:high], label, "left"))
        last = low + int(np.searchsorted(self.label[low:high], label, "right"))
        spans = [(first, last)] if same else [(low, first), (last, high)]
        return [(a, b) for a, b in spans if a < b]


def visit(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) over all pairs in descending order of first[i] + second[j], by a heap.

    A pair enters when both its neighbours in the two sorted sequences that come before are out.
    """
    by1, by2 = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[by1].tolist(), second[by2].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    # out[i]: how many of row i are out; a row waits for the one above it
    out = [0] * len(x)
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, int(by1[i]), int(by2[j])
        out[i] = j + 1
        if j + 1 < len(y) and (i == 0 or out[i - 1] > j + 1):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if i + 1 < len(x) and out[i + 1] == j:
            heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))


class Lists:
    """The best `places` rows of each of many lists of an anchor: score, id, uid."""

    def __init__(self, anchors: int, lists: int, places: int):
        self.score = np.full((anchors, lists, places), NOTHING)
        self.ids = np.full((anchors, lists, places), NO_ID)
        self.uid = np.full((anchors, lists, places), NO_ID)

    def last(self, anchor: int) -> np.ndarray:
        return self.score[anchor, :, -1]

    def put(self, anchor: int, number: int, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        score = np.concatenate([self.score[anchor, number], score])
        ids = np.concatenate([self.ids[anchor, number], ids])
        uid = np.concatenate([self.uid[anchor, number], uid])
        best = np.lexsort((uid, ids, -score))[: self.score.shape[2]]
        self.score[anchor, number], self.ids[anchor, number], self.uid[anchor, number] = score[best], ids[best], uid[best]


def search_block(block: Block, index: Index, anchors, lists: Lists, windows, same: bool) -> None:
    """Bring the lists of all anchors up to date with one block.

    windows[a] has (lowest, highest) of each list, whole numbers; a list takes the best scores
    between them.
    """
    bounds = index.bounds(anchors["vectors"])
    first, second = bounds[0][:, block.codes[0]], bounds[1][:, block.codes[1]]
    for a in range(len(anchors["uid"])):
        low, high = windows[a]
        if not len(low):
            continue
        floor, ceiling = low.min(), high.max()
        vector, label, own = anchors["vectors"][a], int(anchors["label"][a]), anchors["uid"][a]
        waiting: list[tuple[int, int]] = []
        held, due = 0, FIRST_ROWS

        def score_waiting() -> None:
            rows = np.concatenate([np.arange(s, e) for s, e in waiting]) if len(waiting) > 1 else slice(*waiting[0])
            score = (block.vectors[rows] @ vector).astype(np.int64)
            ids, uid = block.ids[rows], block.uid[rows]
            fits = (score >= floor) & (score <= ceiling)
            if same:
                fits &= uid != own
            if not fits.any():
                return
            score, ids, uid = score[fits], ids[fits], uid[fits]
            for number in range(len(low)):
                least = max(low[number], lists.score[a, number, -1])
                better = (score >= least) & (score <= high[number])
                if better.any():
                    lists.put(a, number, score[better], ids[better], uid[better])

        for total, i, j in visit(first[a], second[a]):
            wanted = np.maximum(low, lists.last(a)[: len(low)])
            if total < wanted.min():  # every list is certified
                break
            cell = int(block.codes[0][i]) * CODES + int(block.codes[1][j])
            spans = block.spans(cell, label, same)
            waiting += spans
            held += sum(e - s for s, e in spans)
            if held >= due:
                score_waiting()
                waiting, held, due = [], 0, min(2 * due, ROWS_TO_SCORE)
        if waiting:
            score_waiting()


_FOUND = "anchor int, list int, uid long, id long, score long"


def _searched(rows: DataFrame, index: Index, anchors, windows, places: int, same: bool, width: int) -> DataFrame:
    """The best rows of every list, `places` of them at most from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = anchors.value
        limits = windows.value
        count = len(held["uid"])
        lists = Lists(count, max((len(low) for low, _ in limits), default=1) or 1, places)
        parts: list[pa.RecordBatch] = []
        size = 0

        def flush() -> None:
            nonlocal parts, size
            table = pa.Table.from_batches(parts)
            column = lambda name: table.column(name).combine_chunks()
            numbers = lambda name: column(name).to_numpy(zero_copy_only=False)
            ids = column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            flat = column("vector").flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(-1, width).astype(held["vectors"].dtype)
            block = Block(numbers("code1"), numbers("code2"), numbers("uid"), ids, numbers("label"), vectors)
            search_block(block, index, held, lists, limits, same)
            parts, size = [], 0

        for batch in pieces(batches, BLOCK_ROWS):
            parts.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                flush()
        if size:
            flush()
        anchor, number, place = np.nonzero(lists.score > NOTHING)
        ids = lists.ids[anchor, number, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.astype(np.int32)), pa.array(number.astype(np.int32)),
             pa.array(lists.uid[anchor, number, place]), pa.array(ids, mask=ids == NO_ID),
             pa.array(lists.score[anchor, number, place])],
            names=["anchor", "list", "uid", "id", "score"],
        )

    narrow = rows.select("code1", "code2", "uid", "id", "label", "vector")
    return _first(narrow.mapInArrow(run, _FOUND), places)


def _first(found: DataFrame, places: int) -> DataFrame:
    order = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)


def _exact_type(norms: np.ndarray, width: int):
    """The fastest number type in which no inner product of such vectors is rounded."""
    most = float(norms) * width
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    label: Column | None = None,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `is_anchor` tells the anchors by the columns of rows; `label`, where given, stands for the label.
    """
    spark = rows.sparkSession
    own = F.col(f"`{label_col}`") if label is None else F.when(F.col(f"`{label_col}`").isNotNull(), label)
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    (flag,) = fresh(["uid", "id", "label", "vector"], "anchor")
    used = rows.select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("id"),
        own.cast("long").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias(flag),
    ).where(F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    used = settle(used)
    size = used.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("anchors"), F.max(F.size("vector")).alias("width"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(F.floor(x * scale))))).alias("most"),
    ).first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size.anchors:
        return spark.createDataFrame([], empty)
    width = max(2, size.width)
    kind = _exact_type(min(float(size.most), LIMIT) ** 2, width)

    sampled = used.where(F.pmod(F.xxhash64("uid"), F.lit(size.n)) < SAMPLE).limit(2 * SAMPLE).select("vector")
    points = whole_vectors(sampled.toArrow().column(0).combine_chunks(), width, scale)
    cut = width // 2
    index = Index(width, [codebook(points[:, :cut], CODES), codebook(points[:, cut:], CODES)])
    tasks = int(min(MOST_TASKS, max(1, -(-size.n // ROWS_IN_TASK))))
    indexed = settle(_indexed(used, index, width, scale).repartitionByRange(tasks, "cell", "uid"))
    for number in (0, 1):
        radii = indexed.groupBy(f"code{number + 1}").agg(F.max(f"far{number + 1}"))
        for code, far in radii.collect():  # codes of one half
            index.radii[number][code] = far

    runs = -(-size.anchors // ANCHORS_AT_ONCE)
    found = None
    for number in range(runs):
        asked = used.where(F.col(flag) & (F.pmod(F.xxhash64("uid"), F.lit(runs)) == number)).drop(flag)
        table = asked.orderBy("uid").toArrow()
        if not table.num_rows:
            continue
        column = lambda name: table.column(name).combine_chunks()  # noqa: E731, B023
        anchors = {
            "uid": column("uid").to_numpy(zero_copy_only=False),
            "label": column("label").to_numpy(zero_copy_only=False),
            "vectors": whole_vectors(column("vector"), width, scale).astype(kind),
        }
        part = settle(_mined(indexed, index, anchors, column("id"), width, positives, negatives, low, high))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], empty)


def _mined(indexed, index, anchors, ids, width, positives, negatives, low, high) -> DataFrame:
    spark = indexed.sparkSession
    share = spark.sparkContext.broadcast
    held = share(anchors)
    everything = np.array([NOTHING + 1]), np.array([NO_ID])
    near = settle(
        _searched(indexed, index, held, share([everything] * len(anchors["uid"])), positives, True, width)
    )
    best = near.select("anchor", "score").distinct().orderBy("anchor", F.desc("score")).toArrow()
    of = best.column("anchor").to_numpy()
    score = best.column("score").to_numpy()
    windows = []
    for a in range(len(anchors["uid"])):
        own = score[of == a] if len(of) < 64 else score[np.searchsorted(of, a, "left") : np.searchsorted(of, a, "right")]
        # exact ends of low * p <= 100 * n <= high * p in whole numbers
        windows.append((-((-low * own) // 100), high * own // 100))
    far = _searched(indexed, index, held, share(windows), negatives, False, width)
    names = spark.createDataFrame(
        [(a, None if i is None else int(i)) for a, i in enumerate(ids.to_pylist())], "anchor int, anchor_id long"
    )
    order = Window.partitionBy("anchor").orderBy(F.desc("score"))
    ranked = near.withColumn("list", F.dense_rank().over(order) - 1).select(
        "anchor", "list", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return (
        ranked.join(
            far.select("anchor", "list", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")),
            ["anchor", "list"],
        )
        .join(F.broadcast(names), "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
