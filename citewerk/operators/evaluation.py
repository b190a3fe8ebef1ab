"""Scoring retrieval and reports against known ground truth."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewerk.functions.text import collapse_whitespace, match_form, matches_terms
from citewerk.operators.evidence import explode_evidence
from citewerk.settings import SHORT_EXCERPT

Terms = Sequence[Sequence[str]]
Location = tuple[str, str]

# ---------------------------------------------------------------- retrieval


def recall(
    found: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    methods: Sequence[str],
) -> DataFrame:
    """Share of the expected keys that each method found, per group of `by`.

    `expected` rows carry `by` and `keys`, `found` rows `method` besides. Both sides are
    sets. A method is scored on every group, also one it found nothing for.
    """
    wanted = expected.select(*by, *keys).distinct()
    scored = wanted.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    hits = found.select("method", *by, *keys).distinct().withColumn("_hit", F.lit(1))
    return (
        scored.join(hits, ["method", *by, *keys], "left")
        .groupBy("method", *by)
        .agg(
            F.count("_hit").alias("hits"),
            F.count("*").alias("expected"),
            (F.count("_hit") / F.count("*")).alias("recall"),
        )
    )


def macro_average(recalls: DataFrame, method: str = "method", kind: str = "kind") -> DataFrame:
    """Mean recall per method and kind, and per method over all cases (kind NULL)."""
    return recalls.groupingSets(
        [[F.col(method), F.col(kind)], [F.col(method)]], F.col(method), F.col(kind)
    ).agg(F.avg("recall").alias("mean_recall"), F.count("*").alias("cases"))


# ---------------------------------------------------------------- reports


@dataclass(frozen=True)
class Finding:
    """A built-in issue: found when a risk names it and cites an expected place."""

    label: str
    terms: Terms
    locations: frozenset[Location]


@dataclass(frozen=True)
class Link:
    """A connection no single document states."""

    label: str
    terms: Terms
    only_uncertainties: bool = False


@dataclass(frozen=True)
class Distractor:
    """A settled matter that must not appear as a risk."""

    label: str
    terms: Terms


def _lines(values: Column) -> Column:
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), "\n")


def own_words(risk: Column) -> Column:
    """What the generator wrote itself; quoted excerpts stay out."""
    fields = ("title", "description", "project_area", "impact", "measure", "owner")
    statements = F.transform(risk["facts"], lambda f: f["statement"])
    return F.concat_ws(
        "\n",
        *[risk[f] for f in fields],
        _non_empty(_lines(statements)),
        _non_empty(_lines(risk["conclusions"])),
        _non_empty(_lines(risk["uncertainties"])),
    )


def _non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def headline(risk: Column) -> Column:
    return F.concat_ws("\n", risk["title"], risk["description"], risk["project_area"])


def risk_texts(reports: DataFrame, key: str = "report_id") -> DataFrame:
    """One row per risk with its normalised texts and the places it cites."""
    places = F.array_distinct(
        F.transform(
            F.flatten(F.transform(F.col("risk.facts"), lambda f: f["evidence"])),
            lambda e: F.struct(
                F.col("sources")[e["chunk_id"]]["file_name"].alias("file_name"),
                F.col("sources")[e["chunk_id"]]["locator"].alias("locator"),
            ),
        )
    )
    return reports.select(key, "sources", F.posexplode("risks").alias("risk_pos", "risk")).select(
        key,
        "risk_pos",
        F.col("risk.title").alias("title"),
        match_form(own_words(F.col("risk"))).alias("words"),
        match_form(_lines(F.col("risk.uncertainties"))).alias("doubts"),
        match_form(headline(F.col("risk"))).alias("headline"),
        places.alias("places"),
    )


def term_hits(rows: DataFrame, rules: Sequence[tuple[str, Column, Terms]]) -> DataFrame:
    """Rows with `labels`, the rules whose terms their text matches.

    The rules are a short list held by the caller, so they become expressions on each
    row; there is no join of risks with rules.
    """
    hits = [F.when(matches_terms(text, terms), F.lit(label)) for label, text, terms in rules]
    return rows.withColumn("labels", F.filter(F.array(*hits), lambda label: label.isNotNull()))


def _places_literal(locations: frozenset[Location]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(f).alias("file_name"), F.lit(place).alias("locator"))
            for f, place in sorted(locations)
        ]
    )


def findings_found(risks: DataFrame, findings: Sequence[Finding], key: str = "report_id") -> DataFrame:
    """Per report and finding: whether it was found, cited places and risk titles."""
    verdicts = []
    for finding in findings:
        expected = _places_literal(finding.locations)
        cited = F.array_intersect("places", expected)
        verdicts.append(
            F.struct(
                F.lit(finding.label).alias("label"),
                F.lit(len(finding.locations)).alias("expected"),
                (matches_terms(F.col("words"), finding.terms) & (F.size(cited) > 0)).alias("hit"),
                cited.alias("cited"),
            )
        )
    rows = risks.select(key, "title", F.inline(F.array(*verdicts)))
    hit = F.col("hit")
    return rows.groupBy(key, "label", "expected").agg(
        F.bool_or(hit).alias("found"),
        F.size(
            F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("cited")))))
        ).alias("covered"),
        F.array_sort(F.collect_set(F.when(hit, F.col("title")))).alias("titles"),
    )


def labels_found(
    risks: DataFrame,
    rules: Sequence[tuple[str, str, Terms]],
    key: str = "report_id",
) -> DataFrame:
    """Per report: the labels any of its risks matched. Rules are (label, column, terms)."""
    texts = [(label, F.col(column), terms) for label, column, terms in rules]
    return (
        term_hits(risks, texts)
        .groupBy(key)
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"))
    )


def links_found(risks: DataFrame, links: Sequence[Link], key: str = "report_id") -> DataFrame:
    rules = [(x.label, "doubts" if x.only_uncertainties else "words", x.terms) for x in links]
    return labels_found(risks, rules, key)


def distractors_found(
    risks: DataFrame, distractors: Sequence[Distractor], key: str = "report_id"
) -> DataFrame:
    return labels_found(risks, [(x.label, "headline", x.terms) for x in distractors], key)


def isolation_columns(foreign_terms: Sequence[str]) -> list[Column]:
    """Sources of other projects and terms that belong to another project, of a report's row."""
    sources = F.map_values("sources")
    text = match_form(
        F.concat(
            _lines(F.transform("risks", own_words)),
            _lines(F.transform(sources, lambda c: c["text"])),
        )
    )
    terms = F.array(*[F.lit(t) for t in foreign_terms]).cast("array<string>")
    return [
        F.size(F.filter(sources, lambda c: c["project_id"] != F.col("project_id"))).alias(
            "foreign_sources"
        ),
        F.filter(terms, lambda t: F.contains(text, t)).alias("foreign_terms"),
    ]


def isolation(reports: DataFrame, foreign_terms: Sequence[str], key: str = "report_id") -> DataFrame:
    return reports.select(key, *isolation_columns(foreign_terms))


def risk_forms(risks: Column, sources: Column) -> Column:
    """For each risk of a row its title, normalised texts and cited places."""
    def form(risk: Column) -> Column:
        evidence = F.flatten(F.transform(risk["facts"], lambda f: f["evidence"]))
        places = F.transform(
            evidence,
            lambda e: F.struct(
                sources[e["chunk_id"]]["file_name"].alias("file_name"),
                sources[e["chunk_id"]]["locator"].alias("locator"),
            ),
        )
        return F.struct(
            risk["title"].alias("title"),
            match_form(own_words(risk)).alias("words"),
            match_form(_lines(risk["uncertainties"])).alias("doubts"),
            match_form(headline(risk)).alias("headline"),
            F.array_distinct(places).alias("places"),
        )

    return F.transform(risks, form)


def finding_verdicts(forms: Column, findings: Sequence[Finding]) -> Column:
    """For each finding: found, covered places, expected places and risk titles, in one row."""
    def verdict(finding: Finding) -> Column:
        expected = _places_literal(finding.locations)
        hits = F.filter(
            forms,
            lambda r: matches_terms(r["words"], finding.terms)
            & (F.size(F.array_intersect(r["places"], expected)) > 0),
        )
        cited = F.flatten(F.transform(hits, lambda r: F.array_intersect(r["places"], expected)))
        return F.struct(
            F.lit(finding.label).alias("label"),
            (F.size(hits) > 0).alias("found"),
            F.size(F.array_distinct(cited)).alias("covered"),
            F.lit(len(finding.locations)).alias("expected"),
            F.array_sort(F.array_distinct(F.transform(hits, lambda r: r["title"]))).alias("titles"),
        )

    return F.array_sort(F.array(*[verdict(f) for f in findings])) if findings else F.array()


def matched_labels(forms: Column, rules: Sequence[tuple[str, str, Terms]]) -> Column:
    """Labels that any risk of the row matches. Rules are (label, field, terms)."""
    def hit(label: str, field: str, terms: Terms) -> Column:
        return F.when(F.exists(forms, lambda r: matches_terms(r[field], terms)), F.lit(label))

    found = F.array(*[hit(*rule) for rule in rules]).cast("array<string>")
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def figure_columns() -> list[Column]:
    """Size of a report: risks, facts, evidence, short excerpts, risks without conclusion."""
    facts = F.flatten(F.transform("risks", lambda r: r["facts"]))
    evidence = F.flatten(F.transform(facts, lambda f: f["evidence"]))
    short = F.filter(evidence, lambda e: F.length(F.trim(e["excerpt"])) < SHORT_EXCERPT)
    bare = F.filter("risks", lambda r: F.coalesce(F.size(r["conclusions"]), F.lit(0)) <= 0)
    return [
        F.size("risks").alias("risks"),
        F.size(facts).alias("facts"),
        F.size(evidence).alias("evidence"),
        F.size(short).alias("short_excerpts"),
        F.size(bare).alias("risks_without_conclusion"),
    ]


def report_figures(reports: DataFrame, key: str = "report_id") -> DataFrame:
    return reports.select(key, *figure_columns())


# ---------------------------------------------------------------- numbering


def ordered_risks(rows: DataFrame, key: str = "report_id") -> DataFrame:
    """Risks with `number`: by severity, then probability, then their given order.

    Rows need severity, probability and risk_pos. The number is local to a report,
    which a generator wrote in one answer, so a window per report is small.
    """
    def weight(level: str) -> Column:
        return F.when(F.col(level) == "hoch", 0).when(F.col(level) == "mittel", 1).otherwise(2)

    order = Window.partitionBy(key).orderBy(weight("severity"), weight("probability"), "risk_pos")
    return rows.withColumn("number", F.row_number().over(order))


def source_numbers(evidence: DataFrame, key: str = "report_id", position: Sequence[str] = ()) -> DataFrame:
    """Cited chunks numbered in order of their first mention, per report."""
    position = list(position) or ["risk_pos", "fact_pos", "evidence_pos"]
    first = evidence.groupBy(key, "chunk_id").agg(F.min(F.struct(*position)).alias("_first"))
    order = Window.partitionBy(key).orderBy("_first")
    return first.withColumn("number", F.row_number().over(order)).drop("_first")


def excerpts_by_source(evidence: DataFrame, key: str = "report_id") -> DataFrame:
    """Distinct excerpts per cited chunk, white space collapsed, in order of first mention."""
    position = F.struct("risk_pos", "fact_pos", "evidence_pos")
    distinct = (
        evidence.withColumn("excerpt", collapse_whitespace(F.col("excerpt")))
        .groupBy(key, "chunk_id", "excerpt")
        .agg(F.min(position).alias("_first"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("_first", "excerpt")))
    return distinct.groupBy(key, "chunk_id").agg(
        F.transform(ordered, lambda e: e["excerpt"]).alias("excerpts")
    )


def cited_sources(reports: DataFrame, key: str = "report_id") -> DataFrame:
    """Ids each report cites, sorted."""
    return explode_evidence(reports, key).groupBy(key).agg(
        F.array_sort(F.collect_set("chunk_id")).alias("cited")
    )
