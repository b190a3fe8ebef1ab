"""Benchmark decontamination by edit distance: CGK embeddings, bit-sampling LSH, exact check.

A benchmark item leaks into a document when some stretch of the document is within
`edit_share` x item length edits of it; both are compared as lower-case words joined by blanks.

Windows of the size of the items start at every word of every document. A CGK random walk reads a
window and moves on by a random bit that depends on step and character; so strings at a small
edit distance give walks at a small Hamming distance. Each repetition samples nine steps of
one of `walks` walks over the whole window (its last sample depends on the size band of
the item), and a window is a candidate of an item when all samples agree. So that edits in one part of an item
do not spoil all repetitions, an item is entered from up to `anchors` words spread over all of it. Windows
that disagree with every item in the early samples of a repetition are given up early, which
changes nothing in the result. Candidates that share too few runs of three characters with the item to be
within the allowed edits are put aside, the others verified with an exact bit-parallel edit distance.

Unedited passages are found: their windows give equal walks, as long as a sampled step lies inside
the item, which fails with a chance of about 1 % in one repetition and so never in all. For edited
ones recall depends on `walks` x `repetitions` x `anchors`; the tests measure it (0.9 and more in each band of
edits up to `edit_share`). Short items have samples of their own that fit into them (`SCALES`), with
`SHORT_WALKS` and `SHORT_REPETITIONS` at least where they are shorter than `SHORT`.

The items are a stated query set: they are read in blocks of at most `block_items` items and
`block_chars` characters, the size that is proven for what tasks get; documents are not shuffled, and
between blocks they are written with what was found.

Defined results: a null text counts as empty and leaks nothing; items of three to five characters allow
no edits and match whole words only; items with fewer than three characters match nothing;
items that repeat are all listed; one row for each row of docs, in any number of blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewerk.llm.shared import fresh, pieces, texts, written

_WORD = re.compile(r"[^\W_]+")
#: ASCII bytes that are no letters or digits become blanks; other characters that end words are odd.
_ASCII_WORDS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_ODD = re.compile(r"[^\w\x00-\x7f]")
SYMBOLS = 64
#: (least item length, ends of the levels): of SAMPLES samples 4 are taken before the first end,
#: two before the second and two before the third; the last lies in the rest of the window. Scales with
#: the same first end and as many walks share bits and first samples, so that windows walk once for them.
SCALES = (
    (6, (2, 3, 5)), (12, (5, 9, 14)), (24, (8, 18, 32)), (48, (12, 18, 40)), (72, (12, 18, 48)),
)
SAMPLES = (4, 2, 2)
#: Items below this many characters are not looked for.
SHORTEST = 3
#: Below this many characters few words are there to enter from: scales of such items walk more.
SHORT, SHORT_WALKS, SHORT_REPETITIONS = 48, 3, 6
#: No entry needs more of an item behind it.
ENOUGH = 72
#: Candidates without enough runs of so many symbols of the item are no leaks and not measured.
GRAM = 3
BATCH_CHARS = 1 << 21
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal_form(text: str) -> str:
    """Lower-case words joined by blanks."""
    lower = text.lower()
    plain = b" ".join(lower.encode().translate(_ASCII_WORDS).split()).decode()
    if plain.isascii() or not _ODD.search(plain):
        return plain
    return " ".join(_WORD.findall(lower))


def codes_of(text: str) -> np.ndarray:
    """A symbol below SYMBOLS for each character."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)


def grams_of(codes: np.ndarray) -> np.ndarray:
    """A number below 2^18 for each run of GRAM symbols."""
    wide = codes.astype(np.int32)
    return (wide[:-2] << 12) | (wide[1:-1] << 6) | wide[2:] if len(wide) >= GRAM else wide[:0]


def best_distance(item: str, text: str) -> int:
    """Smallest edit distance of the item to any stretch of the text (Myers, bit-parallel)."""
    size = len(item)
    if not size:
        return 0
    masks: dict[str, int] = {}
    for k, char in enumerate(item):
        masks[char] = masks.get(char, 0) | 1 << k
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = full, 0, size, size
    for char in text:
        match = masks.get(char, 0)
        vertical = match | minus
        carry = (((match & plus) + plus) ^ plus) | match
        up = minus | ~(carry | plus)
        down = plus & carry
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
        if score < best:
            best = score
    return best


@dataclass
class Plan:
    """Random bits and sampled steps of all walks and repetitions, from one seed."""

    walks: int
    repetitions: int
    longest: int
    ends: tuple[int, int, int]
    seed: int = 11

    def __post_init__(self):
        self.steps = 2 * self.longest + self.ends[-1]
        shape = (self.walks, self.repetitions)
        begins = (0, *self.ends[:-1])
        # the bits of a step and the samples of a level depend on nothing but the seed and where they are
        self.bits = np.stack(
            [np.random.default_rng((self.seed, w)).integers(0, 2, (self.steps, SYMBOLS)) for w in range(self.walks)]
        )
        self.samples = [self._sampled(shape, low, high, n) for low, high, n in zip(begins, self.ends, SAMPLES)]
        self.late = np.random.default_rng((self.seed, 98)).random(shape)

    def _sampled(self, shape: tuple[int, int], low: int, high: int, count: int) -> np.ndarray:
        """Steps of one level, different ones as far as there are so many."""
        rng = np.random.default_rng((self.seed, 97, low, high))
        steps = np.resize(np.arange(low, high), max(count, high - low))
        return np.sort(rng.permuted(np.broadcast_to(steps, (*shape, len(steps))), axis=2)[..., :count], axis=2)

    def late_step(self, walk: int, repetition: int, band: int) -> int:
        """The last sample of windows of a band, somewhere in the rest of the window."""
        low = self.ends[-1]
        high = max(low + 1, int(1.6 * band_size(band)) if band else 0)
        return int(low + self.late[walk, repetition] * (high - low))


def band_of(length: int) -> int:
    """Size bands grow by a half; items shorter than the first belong to it."""
    band = 0
    while band_size(band + 1) <= length:
        band += 1
    return band


def band_size(band: int) -> int:
    return int(40 * 1.5**band)


def _add(keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Keys of up to nine symbols of six bits."""
    return (keys << np.uint64(6)) | symbols


def _member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


def _slot(keys: np.ndarray) -> np.ndarray:
    """Where a table of 2^18 flags holds a key of four symbols."""
    return ((keys ^ (keys >> np.uint32(13))) & np.uint32((1 << 18) - 1)).astype(np.int64)


class Scale:
    """The sampled keys of the entries of one scale, given as (number, item, begin of the entry)."""

    def __init__(self, entries: list[tuple[int, int, int]], bodies: list[str], plan: Plan):
        self.plan = plan
        of = [band_of(len(bodies[item]) - begin) for _, item, begin in entries]
        self.bands = sorted(set(of))
        numbers = np.array([number for number, _, _ in entries], np.int64)
        tail = np.zeros(plan.steps + 1, np.uint8)
        parts, place, held = [], {}, 0
        for item in sorted({item for _, item, _ in entries}):
            parts += [codes_of(bodies[item]), tail]
            place[item], held = held, held + len(bodies[item]) + len(tail)
        codes = np.concatenate(parts)
        starts = np.array([place[item] + begin for _, item, begin in entries], np.int64)
        #: By walk and repetition: flags of the first level, sorted keys of the next two.
        self.levels: dict[tuple[int, int], list[np.ndarray]] = {}
        self.late: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for walk in range(plan.walks):
            seen = self._trace(codes, starts, walk)
            for rep in range(plan.repetitions):
                keys, tables = np.zeros(len(starts), np.uint64), []
                for level, samples in enumerate(plan.samples):
                    for step in samples[walk, rep]:
                        keys = _add(keys, seen[step])
                    tables.append(np.unique(keys))
                flags = np.zeros(1 << 18, bool)
                flags[_slot(tables[0].astype(np.uint32))] = True
                self.levels[walk, rep] = [flags, *tables[1:]]
                for band in self.bands:
                    members = np.flatnonzero(np.array(of) == band)
                    last = _add(keys[members], seen[plan.late_step(walk, rep, band)][members])
                    order = np.argsort(last, kind="stable")
                    self.late[walk, rep, band] = (last[order], numbers[members[order]])

    def _trace(self, codes: np.ndarray, starts: np.ndarray, walk: int) -> dict[int, np.ndarray]:
        """Symbols of the sampled steps of one walk over the entries."""
        plan = self.plan
        wanted = {int(s) for samples in plan.samples for s in samples[walk].ravel()}
        wanted |= {plan.late_step(walk, r, b) for r in range(plan.repetitions) for b in self.bands}
        at, out = starts.copy(), {}
        for step in range(max(wanted) + 1):
            symbols = codes[at]
            if step in wanted:
                out[step] = symbols
            at = at + plan.bits[walk, step][symbols]
        return out

    def rest(self, walk: int, codes, at, some, own, keys) -> tuple[np.ndarray, np.ndarray]:
        """(item number, window number) of the windows that agree in all further samples, too.

        `some` are the windows that still walk and `at` where they stand; own and keys are, for each
        repetition, those of them that it wants and their keys.
        """
        plan, reps = self.plan, range(self.plan.repetitions)
        own, keys, step = list(own), list(keys), plan.ends[0]
        for level, end in enumerate(plan.ends[1:], 1):
            wanted = {int(s) for s in plan.samples[level][walk].ravel()}
            seen = {}
            for step in range(step, end):
                symbols = codes.take(at)
                if step in wanted:
                    seen[step] = symbols
                at = at + plan.bits[walk, step].take(symbols)
            step = end
            for rep in reps:
                for s in plan.samples[level][walk, rep]:
                    keys[rep] = _add(keys[rep], seen[int(s)][own[rep]])
                left = np.flatnonzero(_member(keys[rep], self.levels[walk, rep][level]))
                keys[rep], own[rep] = keys[rep][left], own[rep][left]
            at, some, own = _wanted(at, some, own)
        items, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(at):
            traced = {plan.late_step(walk, r, b): None for r in reps for b in self.bands}
            for step in range(step, max(traced) + 1):
                symbols = codes.take(at)
                if step in traced:
                    traced[step] = symbols
                at = at + plan.bits[walk, step].take(symbols)
            for rep in reps:
                for band in self.bands:
                    last = _add(keys[rep], traced[plan.late_step(walk, rep, band)][own[rep]])
                    table, numbers = self.late[walk, rep, band]
                    low, high = np.searchsorted(table, last), np.searchsorted(table, last, "right")
                    count = high - low
                    hit = np.repeat(np.arange(len(last)), count)
                    inner = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
                    items.append(numbers[np.repeat(low, count) + inner])
                    windows.append(some[own[rep][hit]])
        return np.concatenate(items), np.concatenate(windows)


def _wanted(at: np.ndarray, some: np.ndarray, own: list[np.ndarray]):
    """Windows that at least one repetition still wants, numbered anew."""
    kept = np.zeros(len(at), bool)
    for rows in own:
        kept[rows] = True
    place = np.cumsum(kept) - 1
    return at[kept], some[kept], [place[rows] for rows in own]


def candidates(scales: list[Scale], codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item number, window number) of all windows that agree with an item's samples.

    The scales share walks and first samples: windows walk to the end of the first level once, and
    what some scale wants goes on for each of them.
    """
    plan = scales[0].plan
    items, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    first = {int(s) for s in plan.samples[0].ravel()}
    for walk in range(plan.walks if len(starts) else 0):
        at, seen = starts.astype(np.int32 if len(codes) < 1 << 31 else np.int64), {}
        for step in range(plan.ends[0]):
            symbols = codes.take(at)
            if step in first:
                seen[step] = symbols.astype(np.uint32)
            at = at + plan.bits[walk, step].astype(at.dtype).take(symbols)
        passed = []
        for rep in range(plan.repetitions):
            samples = plan.samples[0][walk, rep]
            key = seen[int(samples[0])]
            for s in samples[1:]:
                key = (key << np.uint32(6)) | seen[int(s)]
            slot = _slot(key)
            hit = np.flatnonzero(_any([scale.levels[walk, rep][0] for scale in scales]).take(slot))
            passed.append((hit, key[hit].astype(np.uint64), slot[hit]))
        for scale in scales:
            own, keys = [], []
            for rep, (hit, key, slot) in enumerate(passed):
                mine = scale.levels[walk, rep][0].take(slot)
                own.append(hit[mine])
                keys.append(key[mine])
            item, window = scale.rest(walk, codes, *_wanted(at, np.arange(len(starts)), own), keys)
            items.append(item)
            windows.append(window)
    pair = np.unique(np.stack([np.concatenate(windows), np.concatenate(items)]), axis=1)
    return pair[1], pair[0]


def _any(flags: list[np.ndarray]) -> np.ndarray:
    return flags[0] if len(flags) == 1 else np.logical_or.reduce(flags)


class ItemIndex:
    """A block of items, ready to be looked for."""

    def __init__(
        self,
        items: list[tuple[object, str]],
        walks: int = 2,
        repetitions: int = 3,
        anchors: int = 24,
        edit_share: float = 0.1,
    ):
        """Walks begin at up to `anchors` words of an item, evenly spread, as long as enough follows."""
        self.edit_share = edit_share
        self.items = [(key, normal_form(text or "")) for key, text in items]
        bodies = [body for _, body in self.items]
        self.entries: list[tuple[int, int]] = []  # (item, where its walk begins)
        by_scale: dict[int, list[tuple[int, int, int]]] = {}
        for number, body in enumerate(bodies):
            size = len(body)
            least = min(ENOUGH, max(SHORT, size / 2)) if size >= ENOUGH else max(SCALES[0][0], size / 3)
            begins = [m.start() + 1 for m in re.finditer(" ", body) if size - m.start() - 1 >= least]
            begins = [0, *begins] if size >= SCALES[0][0] else []
            if len(begins) > anchors:
                begins = [begins[k * len(begins) // anchors] for k in range(anchors)]
            for begin in begins:
                scale = max(k for k, (low, _) in enumerate(SCALES) if low <= size - begin)
                by_scale.setdefault(scale, []).append((len(self.entries), number, begin))
                self.entries.append((number, begin))
        self.scales = []
        for scale, own in sorted(by_scale.items()):
            least, ends = SCALES[scale]
            many = (walks, repetitions)
            if least < SHORT:
                many = (max(walks, SHORT_WALKS), max(repetitions, SHORT_REPETITIONS))
            longest = max(len(bodies[item]) - begin for _, item, begin in own)
            self.scales.append(Scale(own, bodies, Plan(*many, longest, ends)))
        families: dict[tuple, list[Scale]] = {}
        for scale in self.scales:
            plan = scale.plan
            families.setdefault((plan.walks, plan.repetitions, plan.ends[0]), []).append(scale)
        self.families = list(families.values())
        self.grams = [grams_of(codes_of(body)) for body in bodies]
        #: Items too short for a walk, as words between blanks.
        self.exact: dict[str, list[int]] = {}
        for number, body in enumerate(bodies):
            if SHORTEST <= len(body) < SCALES[0][0]:
                self.exact.setdefault(body, []).append(number)
        self.exact_words = max([body.count(" ") + 1 for body in self.exact], default=0)
        self.reach = max([scale.plan.steps + 1 for scale in self.scales], default=1)

    def leaks(self, documents: list[str]) -> list[dict[int, int]]:
        """For each text the items it holds and their edit distances."""
        out: list[dict[int, int]] = [{} for _ in documents]
        batch: list[tuple[int, str]] = []
        held = 0
        for k, text in enumerate(documents):
            normal = normal_form(text)
            if held and held + len(normal) > BATCH_CHARS:
                self._scan(batch, out)
                batch, held = [], 0
            batch.append((k, normal))
            held += len(normal) + 1
        self._scan(batch, out)
        return out

    def _exact(self, batch: list[tuple[int, str]], out: list[dict[int, int]]) -> None:
        """Items of a few characters, looked up by the words that they are made of."""
        for number, text in batch:
            words = text.split(" ")
            for size in range(1, self.exact_words + 1):
                there = set(words) if size == 1 else set(map(" ".join, zip(*[words[k:] for k in range(size)])))
                for body in self.exact.keys() & there:
                    out[number].update(dict.fromkeys(self.exact[body], 0))

    def _scan(self, batch: list[tuple[int, str]], out: list[dict[int, int]]) -> None:
        if self.exact:
            self._exact(batch, out)
        whole = " ".join(text for _, text in batch)
        codes = np.concatenate([codes_of(whole), np.zeros(self.reach, np.uint8)])
        blank = codes_of(" ")[0]
        gaps = codes[: len(whole)] == blank
        starts = np.flatnonzero(~gaps & np.r_[True, gaps[:-1]]) if len(whole) else np.empty(0, np.int64)
        begins = np.cumsum([0, *[len(text) + 1 for _, text in batch]])
        pairs = [candidates(family, codes, starts) for family in self.families]
        found = np.concatenate([np.empty(0, np.int64), *[items for items, _ in pairs]])
        where = np.concatenate([np.empty(0, np.int64), *[windows for _, windows in pairs]])
        owner = np.searchsorted(begins, starts[where], "right") - 1
        done: set[tuple[int, int, int]] = set()
        grams, there = grams_of(codes), np.zeros(1 << 18, bool)
        for entry, start, k in zip(found.tolist(), starts[where].tolist(), owner.tolist()):
            (item, begin), (number, text) = self.entries[entry], batch[k]
            if (item, k, start - begin) in done:
                continue
            done.add((item, k, start - begin))
            body = self.items[item][1]
            allowed = int(self.edit_share * len(body))
            if out[number].get(item, allowed + 1) == 0:
                continue
            at = start - begin - int(begins[k])
            near = text[max(0, at - allowed) : max(0, at + len(body) + allowed)]
            low = max(0, at - allowed) + int(begins[k])
            own = grams[low : low + max(0, len(near) - GRAM + 1)]
            there[own] = True
            common = int(there[self.grams[item]].sum())
            there[own] = False
            # each edit spoils GRAM of an item's runs at most
            if common < len(self.grams[item]) - GRAM * allowed:
                continue
            distance = 0 if body in near else best_distance(body, near)
            if distance <= min(allowed, out[number].get(item, allowed)):
                out[number][item] = distance


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_items: int, block_chars: int):
    """Items in blocks of a bounded size, streamed through the driver one partition at a time."""
    block, chars = [], 0
    rows = items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).toLocalIterator()
    for key, text in rows:
        if block and (len(block) >= block_items or chars + len(text or "") > block_chars):
            yield block
            block, chars = [], 0
        block.append((key, text))
        chars += len(text or "")
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    edit_share: float = 0.1,
    walks: int = 2,
    repetitions: int = 3,
    anchors: int = 24,
    block_items: int = 20_000,
    block_chars: int = 1 << 23,
) -> DataFrame:
    """The columns `keep` of each row of docs with contaminated, item_ids and edit_distances."""
    kind = items.schema[item_id_col].dataType.simpleString()
    leaked, ids, edits, text = fresh(keep, "contaminated", "item_ids", "edit_distances", "text_body")
    columns = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)
    rows = docs.select(*[F.col(f"`{n}`") for n in keep], F.col(f"`{text_col}`").alias(text))
    carried = [*keep, text]
    id_type = pa.list_(_arrow_type(items, item_id_col))

    def searched(index, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 1024):
                found = index.value.leaks(texts(batch.column(len(keep))))
                numbers = [[index.value.items[i][0] for i in sorted(f)] for f in found]
                distances = [[f[i] for i in sorted(f)] for f in found]
                names = [*(keep if last else carried), ids, edits]
                kept = batch.columns[: len(names) - 2]
                if ids in batch.schema.names:
                    numbers = [a + b for a, b in zip(batch.column(ids).to_pylist(), numbers)]
                    distances = [a + b for a, b in zip(batch.column(edits).to_pylist(), distances)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(numbers, id_type), pa.array(distances, pa.list_(pa.int32()))],
                    names=names,
                )

        return run

    context = docs.sparkSession.sparkContext
    blocks = item_blocks(items, item_id_col, item_text_col, block_items, block_chars)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        index = context.broadcast(ItemIndex(block, walks, repetitions, anchors, edit_share))
        last = following is None
        body = "" if last else f"`{text}` string, "
        schema = f"{columns}, {body}`{ids}` array<{kind}>, `{edits}` array<int>"
        rows = rows.mapInArrow(searched(index, last), schema)
        if last:
            break
        rows = written(rows, "leaks")  # one block's index at a time in a task
        block = following
    return rows.select(*[F.col(f"`{n}`") for n in keep], (F.size(ids) > 0).alias(leaked), ids, edits)


def _arrow_type(items: DataFrame, id_col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(items.schema[id_col].dataType)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without contaminated rows, all columns kept."""
    found = find_leaks(docs, items, docs.columns, text_col, **options)
    return found.where(~F.col(found.columns[len(docs.columns)])).select(*[F.col(f"`{n}`") for n in docs.columns])
