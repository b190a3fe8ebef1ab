"""Leaks against brute force, recall by edit rate, edges."""

import random

from citewerk.llm.decontaminate import ItemIndex, best_distance, drop_leaks, find_leaks, normal_form

SYLLABLES = "the tion er an in que ré ß al mo xi 7".split()


def sentence(rng, words):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


def edited(rng, text, share):
    out = list(text)
    for _ in range(int(share * len(text))):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = rng.choice("abcdefgh ")
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, rng.choice("abcdefgh"))
    return "".join(out)


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(150):
        item, text = ("".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(2))
        assert best_distance(item, text) == brute_distance(item, text), (item, text)
    assert best_distance("abc", "") == 3


def test_recall():
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.randint(16, 70))) for i in range(60)]
    index = ItemIndex(items)
    for share, least in ((0, 1.0), (0.01, 0.97), (0.02, 0.9), (0.04, 0.6)):
        docs, wanted = [], 0
        for i, text in items:
            for _ in range(3):
                docs.append(sentence(rng, 40) + " " + edited(rng, text, share) + " " + sentence(rng, 30))
        found = index.leaks(docs)
        hits = sum(k // 3 in f for k, f in enumerate(found))
        print(share, hits / len(docs))
        assert hits >= least * len(docs)
        for k, f in enumerate(found):  # nothing beyond the threshold
            for item, distance in f.items():
                body = index.items[item][1]
                assert distance <= 0.1 * len(body)
                assert best_distance(body, normal_form(docs[k])) <= distance


def test_tables(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, 20)) for i in range(7)] + [(7, None), (8, ""), (9, "short item")]
    items += [(10, items[0][1]), (11, "ox"), (12, "qua vadis"), (13, "zigzag"), (14, "a somewhat longer item of words here")]
    docs = [(1, None, "x"), (2, "", "x"), (3, items[0][1].upper() + "!!", None), (3, items[0][1], "y")]
    docs += [(4, sentence(rng, 30), "z"), (5, sentence(rng, 20_000) + "\n" + items[3][1] + " " + items[5][1], "z")]
    docs += [(7, "so qua Vadis zigzag", "z"), (8, "ox a somewhat-longer item of words here", "z")]
    docs += [(6, "a Short, item", "z"), (None, items[2][1].replace(" ", "*** "), "z")]
    left = spark.createDataFrame(docs, "doc_id long, text string, item_ids string")
    right = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 3):
        found = find_leaks(left, right, ["doc_id", "item_ids"], block_items=block).collect()
        got = sorted((repr(r[0]), sorted(r["item_ids_"]), r.contaminated) for r in found)
        assert got == sorted([
            ("1", [], False), ("2", [], False), ("3", [0, 10], True), ("3", [0, 10], True), ("4", [], False),
            ("5", [3, 5], True), ("6", [9], True), ("7", [12, 13], True), ("8", [14], True), ("None", [2], True),
        ])
    kept = drop_leaks(left, right)
    assert kept.columns == left.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert find_leaks(left.limit(0), right, ["doc_id"]).count() == 0
    assert find_leaks(left, right.limit(0), ["doc_id"]).where("contaminated").count() == 0


def test_recall_in_every_band_of_edits():
    """Whatever brute force finds within the threshold, by band of edits and size of items."""
    rng = random.Random(6)
    for low, high in ((12, 24), (24, 48), (48, 72), (72, 120), (120, 400)):
        items = [(i, normal_form(sentence(rng, 90))[: rng.randint(low, high)].strip()) for i in range(50)]
        index = ItemIndex(items)
        for share in (0.02, 0.04, 0.06, 0.08, 0.1):
            docs, owners = [], []
            for i, (_, body) in enumerate(index.items):
                for _ in range(3):
                    doc = sentence(rng, 40) + " " + edited(rng, body, share) + " " + sentence(rng, 30)
                    if best_distance(body, normal_form(doc)) <= int(0.1 * len(body)):
                        docs.append(doc)
                        owners.append(i)
            hits = sum(i in found for i, found in zip(owners, index.leaks(docs)))
            print(low, high, share, len(docs), hits / len(docs))
            assert hits >= 0.9 * len(docs), (low, high, share, hits, len(docs))


def test_items_of_a_few_characters():
    index = ItemIndex([(0, "zig"), (1, "Q"), (2, "a b c"), (3, "!!"), (4, None), (5, "zig"), (6, "a somewhat longer item")])
    docs = ["so Zig, zag", "zigzag", "q a-b c", "a b cd", "", "x a somewhat longer item zig"]
    got = [sorted(f.items()) for f in index.leaks(docs)]
    assert got == [[(0, 0), (5, 0)], [], [(2, 0)], [], [], [(0, 0), (5, 0), (6, 0)]]


def test_normal_form_as_by_pattern():
    import re

    rng = random.Random(9)
    parts = ["Ab", "é", "_", "-", " ", "\n", "…", "“", "ß", "7", "½", "²", "\x1f", "\u2028", "İ", "ا", "़", "😀"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert normal_form(text) == " ".join(re.findall(r"[^\W_]+", text.lower())), repr(text)


def test_scales_share_first_samples():
    index = ItemIndex([(i, sentence(random.Random(i), 12 + 3 * i)) for i in range(20)])
    for family in index.families:
        first = family[0].plan
        for scale in family[1:]:
            steps = min(first.steps, scale.plan.steps)
            assert (scale.plan.samples[0] == first.samples[0]).all()
            assert (scale.plan.bits[:, :steps] == first.bits[:, :steps]).all()
    assert max(map(len, index.families)) > 1
