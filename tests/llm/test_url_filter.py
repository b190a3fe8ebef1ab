"""URL parts and rules against Python, segmentation by trial, the model against arithmetic."""

import itertools
import math
from collections import Counter

from pyspark.sql import functions as F

from citewerk.llm.url_filter import RULES, filter_urls, segment

URLS = [
    "http://A.Example.com/en/1?x=/es/", "https://www.example.com/en/2#t", "http://www.example.com/EN/2",
    "http://b.example.net/es/3", "http://b.example.net/de/4", "net/es/", None, "", "x://", "a://b://c/d?e",
    "http://example.com", "http://redcar.example.org/en/5", "http://red-car.example.net/fr/6",
    "http://xcom/", "http://red-car.example.com/fr/6" + "/a" * 5_000, "ftp://com/\nx",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    cut = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:cut]


def rule_of(host, path):
    fits = []
    for verdict, rule in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits, default=(0, None, None))[1:]


def pages(spark, urls):
    rows = [(i, u, "<p>red car red car retro.com blog</p>", "h") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_rules_and_parts(spark):
    got = {r.page_id: r for r in filter_urls(pages(spark, URLS), ["page_id"]).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        rule, verdict = rule_of(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (verdict or ("block" if got[i].log_odds > 0 else "allow"))


def test_segment_is_the_best_split():
    counts = {"red": 9, "car": 7, "redc": 1, "ar": 2, "a": 0, "carpet": 3, "pet": 5}
    total = 40
    for name in ("redcar", "carpetred", "xredz", "arar", "q"):
        known = {
            (i, j - i): counts[name[i:j]]
            for i, j in itertools.combinations(range(len(name) + 1), 2) if counts.get(name[i:j])
        }

        def cost(words):
            return sum(
                math.log(counts[w] / total) if counts.get(w) else math.log(10 / total) - len(w) * math.log(10)
                for w in words
            )

        best = -math.inf
        for cuts in itertools.product([0, 1], repeat=len(name) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(name)]
            best = max(best, cost([name[a:b] for a, b in zip(at, at[1:])]))
        assert math.isclose(cost(segment(name, known, total)), best)


def test_model_by_hand(spark):
    """Odds of a url without a rule from counts made in Python; redcar is split like red-car."""
    urls = ["http://red-car.example.com/en/1"] * 3 + ["http://blog.example.com/de/2"] * 4
    urls += ["http://redcar.example.org/en/3", "http://blog.example.org/de/4"]
    got = {r.page_id: r for r in filter_urls(pages(spark, urls), ["page_id"]).collect()}
    kinds = [("red car example com".split(), "en 0".split(), 1)] * 3 + [("blog example com".split(), "de 0".split(), 0)] * 4
    block, allow = Counter(), Counter()
    for host, path, bad in kinds:
        (block if bad else allow).update(["h:" + w for w in host] + ["p:" + w for w in path])
    vocabulary = set(block) | set(allow) | {"h:org"}

    def odds(tokens):
        out = math.log((3 + 1) / (4 + 1))
        for t in tokens:
            out += math.log((block[t] + 1) / (sum(block.values()) + len(vocabulary)))
            out -= math.log((allow[t] + 1) / (sum(allow.values()) + len(vocabulary)))
        return out

    spam = odds("h:red h:car h:example h:org p:en p:0".split())
    assert math.isclose(got[7].log_odds, spam) and got[7].verdict == "block"
    assert got[8].verdict == "allow" and got[8].rule is None


def test_empty(spark):
    none = pages(spark, ["x"]).where(F.lit(False))
    assert filter_urls(none, ["page_id"]).count() == 0
    only = filter_urls(pages(spark, [None, "http://a.org/"]), ["page_id"]).collect()
    assert {r.verdict for r in only} == {"allow"}


def test_long_and_odd_pages(spark):
    """A megabyte of dots, of one run, of opening brackets and of dotted runs; repeated pages."""
    size = 1_000_000
    odd = ["a." * (size // 2), "a" * size, "<" * size, "a..b " * (size // 5), "<p" * (size // 2) + ">red", "." * size]
    plain = "<p>red car red car retro.com blog</p>"
    rows = [(i, f"http://redcar.example.org/en/{i}", h) for i, h in enumerate([*odd, None, plain, plain])]
    rows += [rows[-1], (99, "http://" + "ab-" * 3_000 + ".com/" + "/x1" * 100_000, plain)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = filter_urls(frame, ["page_id"]).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)


def test_word_counts_as_by_plain_patterns(spark):
    import re

    from citewerk.llm.url_filter import word_counts

    rows = ["<p>a.b c..d e.f..g .h i. j</p> x<y z>kk ll<mm", "one.two three<b>four</b>.five <six", "> a.b.c <q.r> ss.tt>", ".. a.", None, ""]
    frame = spark.createDataFrame([(r,) for r in rows], "html string")
    want = Counter()
    for r in rows:
        text = re.sub(r"[^\s.]+(\.[^\s.]+)+", " ", re.sub(r"<[^>]*>", " ", r or ""))
        want.update(w for w in re.split(r"[^a-z]+", text) if 1 < len(w) <= 24)
    none = spark.createDataFrame([], "host string")
    assert {r.word: r.n for r in word_counts(frame, "html", none).collect()} == dict(want)
