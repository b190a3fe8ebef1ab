"""Exact deduplication against grouping in Python."""

import random
from collections import defaultdict

from citewerk.llm.exact_dedup import CopyFinder, drop_copies, find_copies, text_digest
from citewerk.llm.shared import LOWER_BYTES

SCHEMA = "doc_id long, text string, sha string, keep_id int"


def low(text):
    return (text or "").encode().translate(LOWER_BYTES)


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, text_digest((text or b"")).hex()))
    return sorted(out, key=repr)


def rows_of(n):
    random.seed(n)
    rows = [(i, random.choice(["Same", "sAME", "ÄRGER", "ärger", "", None, f"own {i}"]), "s", i) for i in range(n)]
    rows += [(n + 1, "x" * 50_000, "s", 1), (n + 2, "X" * 50_000, None, None), (None, "same", "s", 0)]
    return rows + [rows[0]] * 3 + [(None, "only null", None, None)] * 2


def test_against_brute_force(spark):
    rows = rows_of(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in find_copies(docs).collect()]
    assert sorted(found, key=repr) == brute(rows)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert len(left) == len({low(r[1]) for r in rows})
    assert sorted((r.doc_id for r in left), key=repr) == sorted((r[0] for r in brute(rows) if r[3]), key=repr)


def test_full_filter_stays_exact(spark):
    """A filter far too small for its rows lets all of them through to the exact grouping."""
    rows = [(i, f"text {i % 3_500}", None, None) for i in range(4_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    finder = CopyFinder(docs, bits_per_row=1, max_bits=1 << 18)
    finder.plane.value[:] = 255
    assert finder.kept_rows(docs).count() == 3_500
    unique = CopyFinder(docs)
    assert unique.single.count() >= 2_900


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert find_copies(docs).count() == 0
    assert drop_copies(docs).count() == 0
