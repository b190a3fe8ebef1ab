"""Measuring search and reports against ground truth given as JSON.

Search cases: `[{"label", "kind", "project_id", "question", "expected": [[file, place], ...]}]`.
Report rules: `{"project_id", "findings": [{"label", "terms", "locations"}],
"links": [{"label", "terms", "only_uncertainties"}], "distractors": [{"label", "terms"}],
"foreign_terms": [...]}` with terms as a list of groups of alternatives.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewerk.functions.compounds import NO_PARTS, Parts
from citewerk.functions.tokens import question_lexemes
from citewerk.functions.vectors import Encoder, embed_query
from citewerk.operators import evaluation as ev
from citewerk.operators.postings import Inverted, any_word
from citewerk.operators.retrieval import (
    fetch_chunks,
    fuse,
    text_candidates,
    vector_candidates,
)
from citewerk.settings import CANDIDATES_PER_METHOD, EMBEDDING_DIM, SEARCH_LIMIT

METHODS = ("Vektor", "Volltext", "Hybrid")


@dataclass(frozen=True)
class Case:
    label: str
    kind: str
    project_id: str
    question: str
    expected: frozenset[ev.Location]


@dataclass(frozen=True)
class ReportRules:
    project_id: str
    findings: Sequence[ev.Finding] = ()
    links: Sequence[ev.Link] = ()
    distractors: Sequence[ev.Distractor] = ()
    foreign_terms: Sequence[str] = field(default_factory=tuple)


def cases_from_json(raw: list[dict]) -> list[Case]:
    return [Case(**{**c, "expected": frozenset(map(tuple, c["expected"]))}) for c in raw]


def rules_from_json(raw: dict) -> ReportRules:
    return ReportRules(
        raw["project_id"],
        [
            ev.Finding(f["label"], f["terms"], frozenset(map(tuple, f["locations"])))
            for f in raw.get("findings", [])
        ],
        [ev.Link(**link) for link in raw.get("links", [])],
        [ev.Distractor(**d) for d in raw.get("distractors", [])],
        raw.get("foreign_terms", []),
    )


def evaluate_search(
    index: DataFrame,
    cases: Sequence[Case],
    encoder: Encoder,
    k: int = SEARCH_LIMIT,
    candidates: int = CANDIDATES_PER_METHOD,
    dim: int = EMBEDDING_DIM,
    lexicon: Parts = NO_PARTS,
    inverted: Inverted | None = None,
) -> DataFrame:
    """Recall@k per case and method: method, label, kind, hits, expected, recall.

    All cases of a project are answered by one plan.
    """
    spark = index.sparkSession
    found = []
    ordered = sorted(cases, key=lambda c: c.project_id)
    for project_id, group in groupby(ordered, key=lambda c: c.project_id):
        asked = list(group)
        vectors = [embed_query(c.question, encoder, dim) for c in asked]
        words = [question_lexemes(c.question, lexicon) for c in asked]
        depth = max(k, candidates)
        by_vector = vector_candidates(index, project_id, vectors, depth)
        if inverted is None:
            by_text = text_candidates(index, project_id, words, depth)
        else:
            by_text = any_word(inverted, project_id, words, depth)
        # The hybrid list is fused from its own number of candidates, whatever k is.
        fused = fuse(
            by_vector.where(F.col("vector_rank") <= candidates),
            by_text.where(F.col("text_rank") <= candidates),
            k,
        )
        lists = [
            by_vector.where(F.col("vector_rank") <= k),
            by_text.where(F.col("text_rank") <= k),
            fused,
        ]
        ids = reduce(
            DataFrame.unionByName,
            [
                hits.select("question_no", "chunk_id").withColumn("method", F.lit(method))
                for method, hits in zip(METHODS, lists)
            ],
        )
        chunks = fetch_chunks(index, project_id, ids, len(METHODS) * len(asked) * k)
        numbers = spark.createDataFrame(
            [(n, c.label, c.kind) for n, c in enumerate(asked)],
            "question_no int, label string, kind string",
        )
        found.append(
            chunks.join(F.broadcast(numbers), "question_no").select(
                "method", "label", "kind", "file_name", "locator"
            )
        )
    expected = spark.createDataFrame(
        [(c.label, c.kind, f, place) for c in cases for f, place in sorted(c.expected)],
        "label string, kind string, file_name string, locator string",
    )
    return ev.recall(
        reduce(DataFrame.unionByName, found),
        expected,
        ["file_name", "locator"],
        ["label", "kind"],
        METHODS,
    )


def score_reports(reports: DataFrame, rules: ReportRules) -> DataFrame:
    """One row per report with everything the rules and the run data say about it.

    All of it lies in the report's own row, so nothing is joined or grouped, and a report
    without risks or evidence keeps its row.
    """
    formed = reports.withColumn("_forms", ev.risk_forms(F.col("risks"), F.col("sources")))
    links = [(x.label, "doubts" if x.only_uncertainties else "words", x.terms) for x in rules.links]
    distractors = [(x.label, "headline", x.terms) for x in rules.distractors]
    findings = ev.finding_verdicts(F.col("_forms"), rules.findings)
    isolated = ev.isolation_columns(rules.foreign_terms)
    scored = formed.select(
        "report_id",
        "model_name",
        "created_at",
        "stats.*",
        F.size("sources").alias("cited_chunks"),
        *ev.figure_columns(),
        *isolated,
        findings.alias("findings"),
        ev.matched_labels(F.col("_forms"), links).alias("links"),
        ev.matched_labels(F.col("_forms"), distractors).alias("distractors"),
    )
    return scored.withColumn(
        "findings_found", F.size(F.filter("findings", lambda f: f["found"])).cast("long")
    )
