"""Chat formatting of reply trees: root-to-leaf paths, ranked by score, one conversation each.

Paths come from iterative self-joins that double their reach: after round k every leaf knows its
ancestors up to distance 2^k, so a tree of depth d takes log2(d) rounds and the rows made are
those of the paths themselves. Branches of a tree are ranked by the sum of their messages'
scores; the best `branches` of each tree are formatted.

Template, one turn: `<|turn|>` role, line feed, text `<|end|>` line feed. Inside roles and texts a
backslash is doubled and every control string gets a backslash after its first character, so no
control string is left in them and `parse` reads back exactly what went in. The loss mask is a
list of [start, end) code-point spans of the escaped assistant texts.

Defined results: null role or text counts as empty; a null score as 0; equal branch scores go to
the leaf id that is smaller as text; a message whose parent is not in its tree is a root; messages that repeat
(tree, node) are one message, the greatest by (parent, role, text); messages on or below a cycle
of replies have no root and belong to no path; an empty table gives an empty result.

The result has one row for each turn, in order of `place`, and a conversation is their texts put
together: however long it is, formatting and reading back go through it turn by turn and hold one
batch of turns. Digests need the turns of a conversation in order, so these lie in one partition,
sorted outside of memory. `whole` puts conversations into single rows for those who know them short.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewerk.llm.shared import pieces, settle

TURN, END = "<|turn|>", "<|end|>"
#: Strings that templates of this kind give a meaning; none is left inside a text.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(
    re.escape(TURN) + r"((?:\\.|[^\\\n])*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL
)


def escape(text: str) -> str:
    doubled = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], doubled)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where the text stands in it, escaped."""
    head = TURN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _key(column: Column) -> Column:
    """A text for any value, null included, so that joins meet null keys too."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def leaf_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for every message of every root-to-leaf path; up counts from the leaf.

    messages has text columns tree, node and parent (null for a root), unique by (tree, node).
    """
    own = messages.select("tree", "node")
    known = messages.join(
        own.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known")),
        ["tree", "parent"], "left",
    )
    jump = settle(known.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("to")))
    parents = jump.where("to is not null").select("tree", F.col("to").alias("node"))
    leaves = own.join(parents, ["tree", "node"], "left_anti")
    jumps, rooted = [jump], jump.where("to is null").select("tree", "node")
    moving = jump.where("to is not null")
    limit = open_ways = moving.count()
    while open_ways and 2 ** (len(jumps) - 1) <= limit:  # no chain is longer than all replies
        onward = moving.select("tree", "node", F.col("to").alias("mid"))
        next_step = jumps[-1].select("tree", F.col("node").alias("mid"), F.col("to").alias("far"))
        further = settle(
            onward.join(next_step, ["tree", "mid"], "left").select(
                "tree", "node", F.col("far").alias("to")
            )
        )
        jumps.append(further)
        rooted = rooted.unionByName(further.where("to is null").select("tree", "node"))
        moving = further.where("to is not null")
        open_ways = moving.count()
    # leaves on or below a cycle are never rooted; leaving them out keeps paths finite
    paths = leaves.join(rooted.distinct(), ["tree", "node"], "left_semi").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")
    )
    for k, hop in enumerate(jumps):
        step = hop.where("to is not null")
        above = paths.join(step, ["tree", "node"]).select(
            "tree", "leaf", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up")
        )
        paths = settle(paths.unionByName(above))
    return paths


def best_branches(paths: DataFrame, scores: DataFrame, branches: int) -> DataFrame:
    """(tree, leaf, branch_score, branch_rank) of the best branches of every tree."""
    scored = (
        paths.join(scores, ["tree", "node"])
        .groupBy("tree", "leaf")
        .agg(F.sum("score").alias("branch_score"))
    )
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    return scored.withColumn("branch_rank", F.row_number().over(order)).where(
        F.col("branch_rank") <= branches
    )


def format_trees(
    messages: DataFrame,
    tree_col: str = "tree_id",
    node_col: str = "node_id",
    parent_col: str = "parent_id",
    role_col: str = "role",
    text_col: str = "text",
    score_col: str = "score",
    branches: int = 1,
) -> DataFrame:
    """One row for each turn of each chosen path: tree id, leaf, branch_rank, branch_score, place, formatted,
    loss_start, loss_end (code points of the whole conversation; null where nothing counts for the loss).

    The turns of a conversation lie in one partition in their order.
    """
    columns = {
        "tree": _key(F.col(f"`{tree_col}`")),
        "node": _key(F.col(f"`{node_col}`")),
        "parent": F.when(F.col(f"`{parent_col}`").isNotNull(), _key(F.col(f"`{parent_col}`"))),
        "id": F.col(f"`{tree_col}`"),
        "role": F.coalesce(F.col(f"`{role_col}`"), F.lit("")),
        "text": F.coalesce(F.col(f"`{text_col}`"), F.lit("")),
        "score": F.coalesce(F.col(f"`{score_col}`").cast("double"), F.lit(0.0)),
    }
    all_rows = messages.select(*[c.alias(name) for name, c in columns.items()])
    whole = F.max(F.struct("parent", "role", "text", "score", "id")).alias("m")
    rows = all_rows.groupBy("tree", "node").agg(whole).select("tree", "node", "m.*")
    rows = settle(rows)
    paths = leaf_paths(rows.select("tree", "node", "parent"))
    best = best_branches(paths, rows.select("tree", "node", "score"), branches)
    turns = (
        paths.join(best, ["tree", "leaf"])
        .join(rows.select("tree", "node", "id", "role", "text"), ["tree", "node"])
        .select("tree", "leaf", "id", "branch_rank", "branch_score", "up", "role", "text")
        .repartition("tree", "leaf")
        .sortWithinPartitions("tree", "leaf", F.desc("up"))
    )
    kind = messages.schema[tree_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place, at = None, 0, 0
        for batch in pieces(batches, 512):
            rows = []
            keys = zip(batch.column("tree").to_pylist(), batch.column("leaf").to_pylist())
            said = zip(keys, batch.column("role").to_pylist(), batch.column("text").to_pylist())
            for key, role, text in said:
                if key != own:
                    own, place, at = key, 0, 0
                turn, start, end = format_turn(role, text)
                counts = role == "assistant"
                rows.append((place, turn, at + start if counts else None, at + end if counts else None))
                place, at = place + 1, at + len(turn)
            made = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "leaf", "branch_rank", "branch_score")),
                 *(pa.array(v, k) for v, k in zip(made, kinds))],
                names=["id", "leaf", "branch_rank", "branch_score", "place", "formatted", "loss_start", "loss_end"],
            )

    formatted = turns.mapInArrow(
        run,
        f"id {kind.simpleString()}, leaf string, branch_rank int, branch_score double, place long, "
        "formatted string, loss_start long, loss_end long",
    )
    return formatted.withColumn("leaf", F.expr("substring(leaf, 2)")).withColumnRenamed("id", tree_col)


def whole(formatted: DataFrame, id_col: str) -> DataFrame:
    """One row for each conversation: id, leaf, branch_rank, branch_score, n_turns, formatted, loss_spans.

    For conversations that are known to be short: each is put together in one row.
    """
    turns = F.array_sort(F.collect_list(F.struct("place", "formatted", "loss_start", "loss_end")))
    span = F.transform(
        F.filter("turns", lambda t: t["loss_start"].isNotNull()),
        lambda t: F.struct(t["loss_start"].alias("start"), t["loss_end"].alias("end")),
    )
    return (
        formatted.groupBy(id_col, "leaf", "branch_rank", "branch_score")
        .agg(turns.alias("turns"))
        .select(
            id_col, "leaf", "branch_rank", "branch_score", F.size("turns").cast("long").alias("n_turns"),
            F.array_join("turns.formatted", "").alias("formatted"), span.alias("loss_spans"),
        )
    )


def read_back(formatted: DataFrame, id_col: str, in_order: bool = False) -> DataFrame:
    """Digests of what the formatted conversations and their loss masks hold, read turn by turn.

    `in_order` says that the turns of a conversation lie in one partition in their order, as
    `format_trees` gives them; others are dealt and sorted first.
    """
    rows = formatted.select(id_col, "leaf", "place", "formatted", "loss_start", "loss_end")
    if not in_order:
        rows = rows.repartition(id_col, "leaf").sortWithinPartitions(id_col, "leaf", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = turns = None
        done: list[tuple] = []

        def give() -> pa.RecordBatch:
            made = list(zip(*done)) or [[]] * 6
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(made, kinds)],
                names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        def end() -> None:
            done.append((own[0], turns, told.hexdigest(), loss_chars, loss.hexdigest(), at))

        for batch in pieces(batches, 512):
            for tree, leaf, _, text, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, leaf) != own:
                    if own is not None:
                        end()
                    own, turns, at, loss_chars = (tree, leaf), 0, 0, 0
                    told, loss = hashlib.sha256(), hashlib.sha256()
                for role, body in parse(text):
                    turns += 1
                    told.update(f"{role}\n{body}\n".encode())
                if start is not None:
                    counted = unescape(text[start - at : stop - at])
                    loss.update(counted.encode())
                    loss_chars += len(counted)
                at += len(text)
            yield give()
            done = []
        if own is not None:
            end()
        yield give()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    return rows.mapInArrow(
        run,
        f"`{id_col}` {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long",
    )


def chains(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Linear conversations as reply trees: each row answers the row before it.

    Rows go by turn, then role, then text. The score of a message is its length. Rows are range
    partitioned in that order and numbered in two levels, so a conversation may span partitions.
    """
    taken = conversations.select(
        F.col(id_col).alias("tree_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
    )
    order = ["tree_id", "turn", "role"]
    rows = settle(taken.repartitionByRange(*order).sortWithinPartitions(*order, "text"))
    placed = rows.select("tree_id", F.spark_partition_id().alias("part"))
    sizes = placed.groupBy("part", "tree_id").count()
    # of each partition only the last conversation can go on in the next one, so these are few
    spread = sizes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("tree_id")
    same = sizes.tree_id.eqNullSafe(spread.tree_id)
    before: dict[int, int] = {}
    held: dict[object, int] = {}
    for row in sorted(sizes.join(spread, same, "left_semi").collect(), key=lambda r: r.part):
        if row.tree_id in held:
            before[row.part] = held[row.tree_id]
        held[row.tree_id] = held.get(row.tree_id, 0) + row["count"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = (), 0
        for batch in batches:
            numbers = []
            for part, tree in zip(batch.column("part").to_pylist(), batch.column("tree_id").to_pylist()):
                if (tree,) != own:
                    # the first conversation of a partition may go on from the one before
                    at = before.get(part, 0) if own == () else 0
                    own = (tree,)
                at += 1
                numbers.append(at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("tree_id", "role", "text")), pa.array(numbers, pa.int64())],
                names=["tree_id", "role", "text", "node_id"],
            )

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("tree_id", "role", "text"))
    numbered = rows.withColumn("part", F.spark_partition_id()).mapInArrow(number, f"{kinds}, node_id long")
    return numbered.select(
        "tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
        "role", "text", F.length("text").alias("score"),
    )
