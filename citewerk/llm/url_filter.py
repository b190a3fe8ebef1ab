"""URL filter: rules first, then naive Bayes over the words of host and path.

Rules name a host and a path prefix; one fits its host and all subdomains when the path starts
with its own, and the longest rule wins. Urls that a rule judges are the training data of a
multinomial naive Bayes model, which judges all others. Its tokens: the words of the host, where
names written together are split by a unigram Viterbi, and the words of the path.

Word counts come from the visible text of all pages and from hyphenated host names. A host name's
substrings are joined with those counts as rows, so no vocabulary is broadcast; names are segmented
once for each distinct name, scores are computed once for each distinct host and path pattern.

Defined results: a null url, or one without `://`, has empty host and path, which no rule fits and
which has no tokens, so the prior decides; without blocked training urls all others are allowed;
equal odds allow; of rules that are equally long the first listed wins; repeated pages give equal
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewerk.llm.shared import UPPER, settle
from citewerk.llm.skew import join_counted

Rule = tuple[str, str]

#: (verdict, rule) of the filter in production.
RULES: tuple[Rule, ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: A word of a host name has at most so many letters; longer runs are split.
LONGEST_WORD = 24
#: Longer runs of letters in a host are cut (a part of a host name has 63 characters at most).
LONGEST_NAME = 256


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def judged(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: -len(r[1]))[::-1]:
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html_col: str, hosts: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages and the parts of hyphenated host names."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    # Every pattern goes over a character once: no tag starts behind the last ">", a dotted run is
    # tried at its start only, and possessive groups neither go back nor recurse.
    rest = F.substring_index(html, ">", -1)
    tagged = F.left(html, F.length(html) - F.length(rest))
    visible = F.concat(F.regexp_replace(tagged, r"<[^>]*+>", " "), rest)
    names_out = F.regexp_replace(visible, r"(?<![^\s.])[^\s.]++(?:\.[^\s.]++)++", " ")
    in_text = pages.select(F.explode(F.split(lower_ascii(names_out), r"[^\p{L}]+")).alias("word"))
    hyphened = hosts.select(F.explode(F.split("host", r"\.")).alias("name")).where(
        F.col("name").contains("-")
    )
    in_names = hyphened.select(F.explode(F.split("name", r"[^\p{L}]+")).alias("word"))
    return (
        in_text.unionByName(in_names)
        .where((F.length("word") > 1) & (F.length("word") <= LONGEST_WORD))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def segment(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most likely split of a name; known has counts of (start, length).

    A stretch that is no word costs log(10 / (total * 10^length)), as in unigram segmentation
    by word counts.
    """
    size = len(name)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, size + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            length = end - start
            n = known.get((start, length))
            cost = math.log(n / total) if n else math.log(10 / total) - length * math.log(10)
            options.append((best[start][0] + cost, -length, start))
        score, _, start = max(options)
        best.append((score, start))
    out, end = [], size
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def segmented_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for the distinct letter runs of host names.

    All substrings up to the longest word meet the counts in a join on the word.
    """
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) + 1
    parts = names.select(
        "name", F.explode(F.sequence(F.lit(0), F.length("name") - 1)).alias("start")
    ).select(
        "name", "start",
        F.explode(F.sequence(F.lit(2), F.greatest(
            F.lit(2), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("start"))
        ))).alias("length"),
    )
    words = parts.select("name", "start", "length", F.expr("substring(name, start + 1, length)").alias("word"))
    found = (
        words.join(counts, "word")
        .groupBy("name")
        .agg(F.collect_list(F.struct("start", "length", "n")).alias("known"))
    )

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for name, known in batches:
            yield pd.Series(
                [
                    segment(n, {(k["start"], k["length"]): k["n"] for k in (ks if ks is not None else [])}, total)
                    for n, ks in zip(name, known)
                ],
                dtype=object,
            )

    return names.join(found, "name", "left").select("name", split("name", "known").alias("words"))


def _path_pattern(path: Column) -> Column:
    return F.regexp_replace(lower_ascii(path), r"\p{N}+", "0")


def filter_urls(
    pages: DataFrame,
    keep: list[str],
    url_col: str = "url",
    html_col: str = "html",
    rules: Sequence[Rule] = RULES,
    smoothing: float = 1.0,
) -> DataFrame:
    """The columns `keep` of each page with host, path, rule, verdict and log_odds of blocking."""
    url = F.col(f"`{url_col}`")
    host, path = host_of(url), path_of(url)
    rule, said = judged(F.col("_host"), F.col("_path"), rules)
    # all columns are renamed on the way in, so names of the caller's cannot clash
    seen = (
        pages.select(*[F.col(f"`{n}`").alias(f"_keep{i}") for i, n in enumerate(keep)], host.alias("_host"), path.alias("_path"))
        .withColumn("_rule", rule)
        .withColumn("_said", said)
        .withColumn("_pattern", _path_pattern(F.col("_path")))
        .withColumn("_host_key", F.md5("_host"))
        .withColumn("_pattern_key", F.md5("_pattern"))
    )
    kinds = settle(
        seen.groupBy("_host_key", "_pattern_key")
        .agg(
            F.first("_host").alias("host"),
            F.first("_pattern").alias("pattern"),
            F.sum(F.when(F.col("_said") == "block", 1).otherwise(0)).alias("blocked"),
            F.sum(F.when(F.col("_said") == "allow", 1).otherwise(0)).alias("allowed"),
            F.count(F.lit(1)).alias("urls"),
        )
        .withColumnsRenamed({"_host_key": "host_key", "_pattern_key": "pattern_key"})
    )
    sums_of = [F.sum(n).alias(n) for n in ("blocked", "allowed", "urls")]
    # words carry the short key of their host or pattern, so a long url is not repeated for each of its words
    hosts = settle(kinds.groupBy("host_key").agg(F.first("host").alias("host"), *sums_of))
    patterns = settle(kinds.groupBy("pattern_key").agg(F.first("pattern").alias("pattern"), *sums_of))

    letters = F.regexp_extract_all("host", F.lit(r"\p{L}{1,%d}" % LONGEST_NAME), F.lit(0))
    runs = hosts.select("host_key", F.explode(letters).alias("name"))
    counts = settle(word_counts(pages, html_col, hosts))
    names = segmented_names(runs.select("name").distinct(), counts)
    host_words = settle(
        runs.join(names, "name").select("host_key", F.explode("words").alias("word"))
        .select("host_key", F.concat(F.lit("h:"), "word").alias("token"))
    )
    path_words = patterns.select(
        "pattern_key", F.explode(F.split("pattern", r"[^\p{L}\p{N}]+")).alias("word")
    ).where("word <> ''").select("pattern_key", F.concat(F.lit("p:"), "word").alias("token"))

    counted = (
        host_words.join(hosts, "host_key").select("token", "blocked", "allowed")
        .unionByName(path_words.join(patterns, "pattern_key").select("token", "blocked", "allowed"))
        .groupBy("token")
        .agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    )
    counted = settle(counted)
    sums = counted.agg(F.sum("blocked"), F.sum("allowed"), F.count(F.lit(1))).first()
    blocked, allowed, distinct = (float(v or 0) for v in sums)
    urls = kinds.agg(F.sum("blocked"), F.sum("allowed"), F.sum("urls")).first()
    judged_block, judged_allow, all_urls = (float(v or 0) for v in urls)
    prior = math.log((judged_block + smoothing) / (judged_allow + smoothing))
    if not judged_block:
        prior = -math.inf
    weight = F.log(
        (F.col("blocked") + smoothing) / (blocked + smoothing * max(1.0, distinct))
    ) - F.log((F.col("allowed") + smoothing) / (allowed + smoothing * max(1.0, distinct)))
    weights = counted.select("token", weight.alias("weight"))

    def summed(words: DataFrame, key: str, name: str) -> DataFrame:
        return words.select(key, "token").join(weights, "token").groupBy(key).agg(F.sum("weight").alias(name))

    host_odds = hosts.select("host_key", "urls").join(summed(host_words, "host_key", "host_odds"), "host_key")
    path_odds = patterns.select("pattern_key", "urls").join(summed(path_words, "pattern_key", "path_odds"), "pattern_key")
    zero = F.lit(0.0)
    odds = F.lit(prior) + F.coalesce("host_odds", zero) + F.coalesce("path_odds", zero)
    by_host = join_counted(seen, settle(host_odds.withColumnRenamed("host_key", "_host_key")), "_host_key", "urls", all_urls)
    path_side = settle(path_odds.withColumnRenamed("pattern_key", "_pattern_key"))
    return (
        join_counted(by_host, path_side, "_pattern_key", "urls", all_urls)
        .select(
            *[F.col(f"_keep{i}").alias(n) for i, n in enumerate(keep)],
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            F.col("_rule").alias("rule"),
            F.coalesce("_said", F.when(odds > 0, "block").otherwise("allow")).alias("verdict"),
            odds.alias("log_odds"),
        )
    )
