"""Candidates against a plain search, the forest on held-out findings, edges."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from citewerk.llm.secret_scan import (
    FEATURES,
    Language,
    RandomForest,
    assigned_label,
    candidates,
    describe,
    fit,
    judge,
    learn_language,
)

RUN = re.compile(r"[A-Za-z0-9+/=_-]{16,}")


def finding(rng, secret):
    words = ["reading", "station", "another", "measure"]
    if secret:
        value = "".join(rng.choices("0123456789abcdef" if rng.random() < 0.5 else "ABCxyzw0123456789", k=rng.randint(24, 44)))
        before = rng.choice(['api_key = "', "token: ", 'set secret = "', "use "])
    else:
        value = rng.choice(["".join(rng.choices(words, k=3)), "".join(rng.choices("0123456789", k=18)), "-".join(rng.choices(words, k=3))])
        before = rng.choice(["see ", 'the "', "commit ", "name = "])
    return before, value, rng.choice(['" end', " and so on"])


def test_forest_on_held_out_findings(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1_200):
        secret = rng.random() < 0.4
        before, value, after = finding(rng, secret)
        rows.append((i, f"some reading {before}{value}{after}", "src/main", int(secret)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, truth int")
    language = learn_language(docs, "text")
    assert "reading" in language.words
    found = candidates(docs, ["doc_id", "truth"])
    forest = fit(found.where("doc_id % 4 <> 0"), F.col("truth"), language)
    scored = found.where("doc_id % 4 = 0").withColumn("score", judge(found, forest, language)).collect()
    right = np.mean([(r.score >= 0.5) == bool(r.truth) for r in scored])
    assert len(scored) > 200 and right > 0.97


def test_candidates_and_edges(spark):
    rows = [
        (1, None, "a"), (2, "", None), (3, "x" * 40_000 + " é " + "A1" * 9, "b/c"), (3, "short 123", "b"),
        (4, "k=" + "0" * 16 + ".z", None), (4, "k=" + "0" * 16 + ".z", None), (None, "-" * 20, "t"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("start", F.lit(1))
    got = candidates(docs, ["doc_id", "start"]).collect()
    wanted = [(r[0], m.start(), m.end(), m[0]) for r in rows for m in RUN.finditer(r[1] or "")]
    assert sorted(((r[0], r["start_"], r["end"], r["candidate"]) for r in got), key=repr) == sorted(wanted, key=repr)
    none = docs.limit(0)
    language = learn_language(none, "text")
    forest = fit(candidates(none, ["doc_id"]), F.lit(1), language)
    assert forest.base == 0.5
    found = candidates(docs, ["doc_id"])
    assert {r.s for r in found.select(judge(found, forest, language).alias("s")).collect()} == {0.5}
    labels = found.select(assigned_label(F.col("before"), F.col("candidate")).alias("l")).collect()
    assert {r.l for r in labels} <= {0, None}


def test_features():
    language = Language(np.zeros((29, 29)), frozenset(["word", "wordy"]))
    values = dict(zip(FEATURES, describe("wordy0word", 'a token = "', '" z', "x/tests/y", language)))
    assert values["dictionary coverage"] == 0.9 and values["key word before"] == 1.0
    assert values["quoted"] == 1.0 and values["equals or colon before"] == 1.0 and values["path words"] == 1.0


def test_tree_learns_an_interaction():
    rng = np.random.default_rng(2)
    values = rng.random((2_000, 4))
    labels = ((values[:, 0] > 0.5) ^ (values[:, 1] > 0.5)).astype(float)
    forest = RandomForest().fit(values[:1_500], labels[:1_500])
    assert ((forest.scores(values[1_500:]) > 0.5) == labels[1_500:]).mean() > 0.9


def test_values_of_key_names():
    from citewerk.llm.secret_scan import spans

    long = "A1b2" * 6
    cases = {
        'password = "hunter2-abc"': ["hunter2-abc"],
        "pwd: Tr0ub4dor&3!": ["Tr0ub4dor&3!"],
        "api_key=sk.live:12$ab, next": ["sk.live:12$ab"],
        '{"client_secret": "p\\"q 7", "n": 1}': ['p\\"q 7'],
        "the password is 'x y z' here": ["x y z"],
        "Authorization: Bearer abc.def.ghi": ["abc.def.ghi"],
        "config['token'] = 'é1'": ["é1"],
        "--password=a": ["a"],
        f"token: {long}": [long],
        f"token: {long}.{long} and {long}": [f"{long}.{long}", long],
        f"passwd=a1;{long}\nauthor: {long}": [f"a1;{long}", long],
        "pwd=" + "z9!" * 20_000: ["z9!" * 20_000],
        "author: Jo, authority = x, the token ring and a secret": [],
        "password:": [],
    }
    for text, wanted in cases.items():
        assert [text[a:b] for a, b in spans(text)] == wanted, text[:80]


def test_short_and_punctuated_passwords(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        value = "".join(rng.choices("abcdefgh", k=4)) + rng.choice("&!$.-:") + "".join(rng.choices("0123456789XYZ", k=4))
        digest = "".join(rng.choices("0123456789abcdef", k=40))
        uuid = "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12))
        rows.append((i, f'{rng.choice(["password", "pwd", "db_passwd"])} = "{value}1"\ncommit {digest}\nsee {uuid} in it'))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    language = learn_language(docs, "text")
    found = candidates(docs, ["doc_id"], path_col=None)
    label = assigned_label(F.col("before"), F.col("candidate"))
    assert {(r.l, r["count"]) for r in found.groupBy(label.alias("l")).count().collect()} == {(1, 900), (0, 1_800)}
    forest = fit(found.where("doc_id % 3 > 0"), label, language)
    scored = found.where("doc_id % 3 = 0").withColumn("score", judge(found, forest, language)).collect()
    assert len(scored) == 900
    wrong = [r for r in scored if (r.score >= 0.5) != (len(r.candidate) == 10)]
    assert len(wrong) < 9


def test_names_within_runs():
    from citewerk.llm.secret_scan import spans

    cases = {
        "mytoken=a1": ["a1"], "x_api_key_2 = 'b'": ["b"], "secret_api-key = v": ["v"], "tokentoken: w": ["w"],
        "author_token=c": ["c"], "author-token=d": ["d"], "MY-API-KEY: e": ["e"], "x-access-key=f, auth=g": ["f", "g"],
        "token token=h": ["h"], "private_key2key = i": ["i"], 'token "a"secret="b"': ["a", "b"],
    }
    for text, wanted in cases.items():
        assert [text[a:b] for a, b in spans(text)] == wanted, text


def test_long_runs_take_linear_time(spark):
    """A megabyte of key words, of parts of names and paths, of quotes and blanks, in texts and as candidates."""
    import time

    from citewerk.llm.secret_scan import spans

    size = 1_000_000
    texts = ["token" * (size // 5), "token " * (size // 6), "api-key" * (size // 7), "token" + " " * size,
             'token "' * (size // 7), "token='" + "\\'" * (size // 2), "private_" * (size // 8), "auth" * (size // 4)]
    for text in texts:
        started = time.perf_counter()
        spans(text)
        assert time.perf_counter() - started < 10, text[:20]
    runs = ["abc" + "_a" * (size // 2), "abc/" * (size // 4), "/" * size, "a" * size, "a1-" * (size // 3) + "x/"]
    docs = spark.createDataFrame([(i, f"see {r} and") for i, r in enumerate([*runs, *texts])], "doc_id long, text string")
    found = candidates(docs, ["doc_id"], path_col=None)
    labels = found.select("doc_id", assigned_label(F.col("before"), F.col("candidate")).alias("l")).collect()
    assert {(r.doc_id, r.l) for r in labels if r.doc_id in (0, 1)} == {(0, 0), (1, 0)}


def test_no_plain_candidates_are_kept(spark):
    from citewerk.llm.secret_scan import described, fit_described, judge_described

    rows = [(i, f"password = 'abc{i % 7}&x' and commit " + f"{i:040x}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    language = learn_language(docs, "text")
    label = assigned_label(F.col("before"), F.col("candidate"))
    found = described(candidates(docs, ["doc_id"], path_col=None), ["doc_id"], language, label)
    assert found.columns == ["doc_id", "start", "end", "candidate_sha256", "label", "features"]
    forest, again = fit_described(found, 5), fit_described(found.repartition(3), 5)
    assert all(np.array_equal(a, b) for a, b in zip(forest.nodes, again.nodes))
    assert found.select(judge_described(found, forest).alias("s")).where("s is null").count() == 0
