"""Reply trees against recursion, exact round trip of the template."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citewerk.llm.chat_format import CONTROL, chains, escape, format_trees, format_turn, parse, read_back, unescape, whole

SCHEMA = "tree_id long, node_id long, parent_id long, role string, text string, score double"
PARTS = st.sampled_from([*CONTROL, "\\", "\n", "<", "|turn|>", "[", "é", "a b", "</", "s>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(PARTS).map("".join), st.lists(PARTS).map("".join)), max_size=5))
def test_round_trip(turns):
    made = [format_turn(*turn) for turn in turns]
    assert parse("".join(text for text, _, _ in made)) == turns
    assert [unescape(text[a:b]) for text, a, b in made] == [body for _, body in turns]
    for role, body in turns:
        assert not any(mark in escape(body) for mark in CONTROL)


def brute(rows, branches):
    """Paths by recursion: (tree, leaf) -> texts from the root."""
    out = {}
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in nodes.values()}
        found = []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, seen, at = [], set(), leaf
            while at in nodes and at not in seen:
                seen.add(at)
                path.append(nodes[at])
                at = nodes[at][2]
            if at in seen:
                continue
            found.append((-sum(r[5] or 0.0 for r in path), str(leaf), [(r[3] or "", r[4] or "") for r in path[::-1]]))
        for score, leaf, path in sorted(found, key=lambda f: (f[0], "=" + f[1]))[:branches]:
            out[tree, leaf] = (-score, path)
    return out


def test_trees(spark):
    random.seed(3)
    rows = []
    for tree in range(12):
        for node in range(random.randint(1, 25)):
            parent = None if node == 0 else random.randrange(node)
            rows.append((tree, node, parent, random.choice(["user", "assistant", None]), f"t{tree}.{node}", float(random.randint(0, 3))))
    rows += [(50, 1, 2, "user", "loop", 1.0), (50, 2, 1, "user", "loop", 1.0), (50, 3, 2, "user", "below", 1.0)]
    rows += [(51, 1, 99, "user", "orphan", None), (52, 1, None, None, None, None)]
    rows += [(53, n, n - 1 if n else None, "assistant", f"deep {n}", 1.0) for n in range(70)]
    for branches in (1, 3):
        found = whole(format_trees(spark.createDataFrame(rows, SCHEMA), branches=branches), "tree_id").collect()
        got = {(r.tree_id, r.leaf): (r.branch_score, parse(r.formatted)) for r in found}
        assert got == brute(rows, branches)
        assert all(r.n_turns == len(parse(r.formatted)) for r in found)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert format_trees(empty).count() == 0
    one = [(None, 0, None, "assistant", "x </s>", None), (None, 1, 0, None, None, None)] * 2
    odd = spark.createDataFrame([(*r, 7) for r in one], SCHEMA + ", formatted int")
    found = format_trees(odd)
    assert [parse(r.formatted) for r in whole(found, "tree_id").collect()] == [[("assistant", "x </s>"), ("", "")]]
    back = read_back(found, "tree_id").collect()
    assert [(r.n_turns, r.loss_chars) for r in back] == [(2, 6)]


def test_repeated_turns(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None)],
        "conv_id long, turn long, role string, text string",
    )
    found = whole(format_trees(chains(rows)), "tree_id").collect()
    assert parse(found[0].formatted) == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]


def test_one_very_long_conversation(spark):
    """Two thirds of all rows are one conversation that spans partitions; digests against Python."""
    import hashlib

    rng = random.Random(6)
    text = lambda: rng.choice(["</s>", "a\\b", "x\ny", "é" * 50, ""]) + str(rng.random())
    rows = [(7, t, "assistant" if t % 2 else "user", text()) for t in range(3_000)]
    rows += [(c, t, "assistant" if t % 2 else "user", text()) for c in range(100, 400) for t in range(5)]
    rows += [(None, t, "user", None) for t in range(40)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        formatted = format_trees(chains(frame))
        in_order = {r.tree_id: r for r in read_back(formatted, "tree_id", in_order=True).collect()}
        again = {r.tree_id: r for r in read_back(formatted.orderBy(F.rand(3)), "tree_id").collect()}
        joined = {r.tree_id: r for r in whole(formatted, "tree_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert in_order == again and len(in_order) == 302
    for conv in (7, 100, None):
        turns = [(r[2], r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        told = "".join(f"{role}\n{body}\n" for role, body in turns)
        loss = "".join(body for role, body in turns if role == "assistant")
        got = in_order[conv]
        assert got.n_turns == len(turns) and got.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got.loss_chars == len(loss) and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        text = joined[conv].formatted
        assert got.formatted_chars == len(text) and parse(text) == turns
        assert "".join(unescape(text[s.start : s.end]) for s in joined[conv].loss_spans) == loss
