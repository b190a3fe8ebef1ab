"""Citation checks, answer validation, report scoring and numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewerk.functions.text import match_form, matches_terms
from citewerk.operators.evaluation import (
    Distractor,
    Finding,
    Link,
    cited_sources,
    distractors_found,
    excerpts_by_source,
    findings_found,
    isolation,
    links_found,
    macro_average,
    ordered_risks,
    recall,
    report_figures,
    risk_texts,
    source_numbers,
)
from citewerk.operators.evidence import check_citations, explode_evidence, shape_problems
from citewerk.plans.sample_views import VIEWS, table, view
from citewerk.queries.registry import query
from citewerk.schemas import ANALYSIS, RISK_CATEGORIES

# Citations an answer could contain: verbatim, re-spaced, altered, empty or invented ones.
# A report is one answer, here of 25 citations.
VIEWS["cited"] = (
    "documents",
    {
        "report_id": "'R' || CAST(doc_id - doc_id % 25 AS STRING)",
        "risk_pos": "CAST(doc_id % 4 AS INT)",
        "fact_pos": "CAST(doc_id % 3 AS INT)",
        "evidence_pos": "CAST(doc_id % 25 AS INT)",
        "title": "'Risiko ' || CAST(doc_id % 4 AS STRING)",
        "statement": "'Fakt ' || lang",
        "chunk_id": (
            "CASE WHEN doc_id % 10 = 3 THEN 'erfunden' "
            "ELSE lpad(CAST(doc_id - doc_id % 2 AS STRING), 12, '0') END"
        ),
        "excerpt": (
            "CASE doc_id % 6 WHEN 0 THEN substr(text, 1, 80) WHEN 1 THEN 'Kopie' "
            "WHEN 2 THEN '  ' || replace(substr(text, 4, 60), ' ', '  ') "
            "WHEN 4 THEN substr(text, 5, 40) || ' geändert' ELSE ' ' END"
        ),
        "severity": (
            "CASE doc_id % 3 WHEN 0 THEN 'mittel' WHEN 1 THEN 'hoch' ELSE 'niedrig' END"
        ),
        "probability": (
            "CASE n_chars % 3 WHEN 0 THEN 'mittel' WHEN 1 THEN 'hoch' ELSE 'niedrig' END"
        ),
    },
)

COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
HAYSTACK = COLLAPSE.format("coalesce(c.heading, '') || ' ' || c.text")
NEEDLE = COLLAPSE.format("e.excerpt")


@query(
    f"""
    SELECT e.report_id, e.evidence_pos, e.chunk_id, CASE
        WHEN c.chunk_id IS NULL THEN 'Quelle ''' || e.chunk_id || ''' wurde nicht geliefert.'
        WHEN c.project_id <> 'DOC-1' THEN
            'Quelle ''' || e.chunk_id || ''' gehört nicht zu DOC-1.'
        WHEN {NEEDLE} = '' OR NOT contains({HAYSTACK}, {NEEDLE}) THEN
            'Der Auszug „' || e.excerpt || '“ steht nicht wörtlich in Quelle ''' || e.chunk_id || '''.'
        END AS problem
    FROM cited e LEFT JOIN corpus c ON e.chunk_id = c.chunk_id
    """,
    "cited",
    "corpus",
)
def citation_check(spark, folder):
    checked = check_citations(view(spark, folder, "cited"), view(spark, folder, "corpus"), "DOC-1")
    return checked.select("report_id", "evidence_pos", "chunk_id", "problem")


@query(
    """
    SELECT report_id, chunk_id, row_number() OVER (PARTITION BY report_id ORDER BY seen) AS number
    FROM (SELECT report_id, chunk_id, min((risk_pos, fact_pos, evidence_pos)) AS seen
          FROM cited GROUP BY 1, 2)
    """,
    "cited",
)
def source_numbering(spark, folder):
    return source_numbers(view(spark, folder, "cited"))


@query(
    f"""
    WITH seen AS (
        SELECT report_id, chunk_id, {NEEDLE} AS excerpt,
               min((risk_pos, fact_pos, evidence_pos)) AS first
        FROM cited e GROUP BY 1, 2, 3
    )
    SELECT report_id, chunk_id, string_agg(excerpt, ' | ' ORDER BY first) AS excerpts
    FROM seen GROUP BY 1, 2
    """,
    "cited",
)
def excerpt_lists(spark, folder):
    found = excerpts_by_source(view(spark, folder, "cited"))
    return found.withColumn("excerpts", F.array_join("excerpts", " | "))


@query(
    """
    WITH ranks AS (
        SELECT *, CASE severity WHEN 'hoch' THEN 0 WHEN 'mittel' THEN 1 ELSE 2 END AS s,
               CASE probability WHEN 'hoch' THEN 0 WHEN 'mittel' THEN 1 ELSE 2 END AS p
        FROM cited
    )
    SELECT report_id, evidence_pos AS risk_pos, severity, probability,
           row_number() OVER (PARTITION BY report_id ORDER BY s, p, evidence_pos) AS number
    FROM ranks
    """,
    "cited",
)
def risk_order(spark, folder):
    risks = view(spark, folder, "cited").select(
        "report_id", F.col("evidence_pos").alias("risk_pos"), "severity", "probability"
    )
    return ordered_risks(risks)


# ---------------------------------------------------------------- answers as JSON

_FACT = '{"statement": "s", "evidence": [{"chunk_id": "c", "excerpt": "e"%s}]}'


def _answer(change: str = "", facts: str | None = None, **fields: str | None) -> str:
    """An answer of one risk as an SQL string expression over documents."""
    values = {
        "title": '"T #"',
        "category": '"termin"',
        "description": '"d"',
        "project_area": '"Haus B"',
        "impact": '"i"',
        "probability": '"hoch"',
        "severity": '"mittel"',
        "owner": '"o"',
        "measure": '"m"',
        "status": '"offen"',
        "facts": "[" + (_FACT % "" if facts is None else facts) + "]",
        **fields,
    }
    body = ", ".join(f'"{k}": {v}' for k, v in values.items() if v is not None)
    return '{"risks": [{' + body + "}]" + change + "}"


SHAPES = [
    (_answer(), ""),
    (_answer(conclusions='["k"]', uncertainties="[]"), ""),
    (_answer(owner=None), "fehlende oder unbekannte Felder|Pflichtfeld ohne Text"),
    (_answer(color='"rot"'), "fehlende oder unbekannte Felder"),
    (_answer(severity='"extrem"'), "Wert außerhalb der Aufzählung"),
    (_answer(facts=""), "Fakt ohne Beleg"),
    (_answer(facts='{"statement": "s", "evidence": []}'), "Fakt ohne Beleg"),
    (_answer(facts=_FACT % ', "page": 1'), "fehlende oder unbekannte Felder"),
    (_answer(change=', "comment": "x"'), "kein Objekt mit genau dem Feld risks"),
    ('{"risks": []}', ""),
    (_answer(title="5"), "fehlende oder unbekannte Felder"),
    (_answer(measure="null"), "fehlende oder unbekannte Felder|Pflichtfeld ohne Text"),
    (_answer(conclusions="null"), "fehlende oder unbekannte Felder"),
    (_answer(uncertainties='["k", null]'), "fehlende oder unbekannte Felder"),
    (_answer(facts='{"statement": null, "evidence": [{"chunk_id": "c", "excerpt": "e"}]}'), "fehlende oder unbekannte Felder"),
    (_answer(facts='{"statement": "s", "evidence": [{"chunk_id": null, "excerpt": "e"}]}'), "fehlende oder unbekannte Felder"),
    (_answer() + " Ende", "fehlende oder unbekannte Felder"),
    (
        "keine Antwort",
        "kein Objekt mit genau dem Feld risks|fehlende oder unbekannte Felder|"
        "Pflichtfeld ohne Text|Wert außerhalb der Aufzählung|Fakt ohne Beleg",
    ),
]
_CASES = " ".join(f"WHEN {n} THEN '{text}'" for n, (text, _) in enumerate(SHAPES))
ANSWER = f"replace(CASE doc_id % {len(SHAPES)} {_CASES} END, '#', CAST(doc_id AS STRING))"
_EXPECTED = " ".join(f"WHEN {n} THEN '{expected}'" for n, (_, expected) in enumerate(SHAPES))


@query(
    f"""
    SELECT doc_id, {ANSWER} AS answer, CASE doc_id % {len(SHAPES)} {_EXPECTED} END AS problems
    FROM documents
    """
)
def answer_validation(spark, folder):
    answers = table(spark, folder, "documents").selectExpr("doc_id", f"{ANSWER} AS answer")
    parsed = answers.withColumn("analysis", F.from_json("answer", ANALYSIS))
    found = shape_problems(F.col("answer"), F.col("analysis"))
    return parsed.select("doc_id", "answer", F.array_join(found, "|").alias("problems"))


# ---------------------------------------------------------------- whole reports


def reports(spark, folder):
    """One report of two risks per document; its sources carry two cited chunks."""
    d = table(spark, folder, "documents")

    def cite(factor: int, start: int) -> dict:
        return {
            "chunk_id": F.concat(F.lit("q"), ((F.col("doc_id") * factor) % 50).cast("string")),
            "excerpt": F.substring("text", start, 30),
        }

    def struct(fields: dict):
        return F.struct(*[value.alias(name) for name, value in fields.items()])

    def risk(title: str, start: int, facts: list):
        middle = F.substring("text", start, 150)
        return struct(
            {
                "title": F.concat(F.lit(title), F.lit(" "), "source"),
                "category": F.element_at(
                    F.array(*[F.lit(c) for c in RISK_CATEGORIES]), (F.col("doc_id") % 9 + 1).cast("int")
                ),
                "description": middle,
                "project_area": F.upper("lang"),
                "impact": F.substring("text", start + 150, 50),
                "probability": F.lit("hoch"),
                "severity": F.lit("mittel"),
                "owner": F.lit("nicht benannt"),
                "measure": F.substring("text", start + 200, 50),
                "status": F.lit("offen"),
                "facts": F.array(*facts),
                "conclusions": F.when(
                    F.col("doc_id") % 2 == 0, F.array(F.substring("text", start + 250, 60))
                ).otherwise(F.array().cast("array<string>")),
                "uncertainties": F.when(
                    F.col("doc_id") % 3 == 0, F.array(F.substring("text", start + 310, 60))
                ).otherwise(F.array().cast("array<string>")),
            }
        )

    def fact(start: int, *evidence):
        return struct(
            {"statement": F.substring("text", start, 40), "evidence": F.array(*map(struct, evidence))}
        )

    def source(factor: int):
        number = (F.col("doc_id") * factor) % 50
        return struct(
            {
                "project_id": F.when(number % 10 == 9, "DOC-2").otherwise("DOC-1"),
                "file_name": F.concat(F.lit("datei_"), (number % 7).cast("string")),
                "locator": F.concat(F.lit("S. "), (number % 5).cast("string")),
                "text": F.concat(F.lit("Quelle "), number.cast("string"), F.lit(" grundschule")),
            }
        )

    first = risk("Termin", 1, [fact(10, cite(1, 1), cite(7, 20)), fact(60, cite(1, 100))])
    second = risk("Kosten", 400, [fact(420, cite(7, 12))])
    keys = F.array(cite(1, 1)["chunk_id"], cite(7, 1)["chunk_id"])
    return d.select(
        F.col("doc_id").alias("report_id"),
        F.lit("DOC-1").alias("project_id"),
        F.array(first, second).alias("risks"),
        # Both citations can name the same chunk, which a map holds once.
        F.map_from_entries(
            F.array_distinct(F.arrays_zip(keys.alias("key"), F.array(source(1), source(7)).alias("value")))
        ).alias("sources"),
    )


def _risk_sql(pos: int, title: str, start: int, statements: list[int], cites: list[int]) -> str:
    facts = " || chr(10) || ".join(f"substr(text, {s}, 40)" for s in statements)
    places = ", ".join(
        f"{{'f': 'datei_' || CAST((doc_id * {c}) % 50 % 7 AS VARCHAR), "
        f"'l': 'S. ' || CAST((doc_id * {c}) % 50 % 5 AS VARCHAR)}}"
        for c in cites
    )
    return f"""
        SELECT doc_id AS report_id, {pos} AS risk_pos, '{title} ' || source AS title,
               substr(text, {start}, 150) AS description, upper(lang) AS area,
               '{title} ' || source || chr(10) || substr(text, {start}, 150) || chr(10) || upper(lang)
               || chr(10) || substr(text, {start + 150}, 50) || chr(10) || substr(text, {start + 200}, 50)
               || chr(10) || 'nicht benannt' || chr(10) || {facts}
               || CASE WHEN doc_id % 2 = 0 THEN chr(10) || substr(text, {start + 250}, 60) ELSE '' END
               || CASE WHEN doc_id % 3 = 0 THEN chr(10) || substr(text, {start + 310}, 60) ELSE '' END
               AS words,
               CASE WHEN doc_id % 3 = 0 THEN substr(text, {start + 310}, 60) ELSE '' END AS doubts,
               list_distinct([{places}]) AS places
        FROM documents"""


MATCH_FORM = "trim(regexp_replace(replace(lower({}), '–', '-'), '\\s+', ' ', 'g'))"
RISKS_SQL = f"""
    raw_risks AS (
        {_risk_sql(0, "Termin", 1, [10, 60], [1, 7])} UNION ALL {_risk_sql(1, "Kosten", 400, [420], [7])}
    ), risks AS (
        SELECT report_id, risk_pos, title, places, {MATCH_FORM.format("words")} AS words,
               {MATCH_FORM.format("doubts")} AS doubts,
               {MATCH_FORM.format("title || chr(10) || description || chr(10) || area")} AS headline
        FROM raw_risks
    )"""

FINDINGS = [
    Finding("F1", (("termin", "kosten"), ("ver", "tion")), frozenset({("datei_1", "S. 1"), ("datei_3", "S. 3")})),
    Finding("F2", (("nicht benannt",), ("mit ", "with ")), frozenset({("datei_0", "S. 0")})),
]
LINKS = [Link("L1", (("der", "the"), ("ch",))), Link("L2", (("en",),), only_uncertainties=True)]
DISTRACTORS = [Distractor("D1", (("src1",),)), Distractor("D2", (("kosten",), ("ment",)))]
FOREIGN = ("grundschule", "schkeit")


def _terms_sql(column: str, terms) -> str:
    groups = [" OR ".join(f"contains({column}, '{t}')" for t in group) for group in terms]
    return " AND ".join(f"({g})" for g in groups)


def _finding_sql(finding: Finding) -> str:
    places = ", ".join(f"{{'f': '{f}', 'l': '{place}'}}" for f, place in sorted(finding.locations))
    return f"""
        SELECT report_id, '{finding.label}' AS label, {len(finding.locations)} AS expected, title,
               list_intersect(places, [{places}]) AS cited,
               {_terms_sql("words", finding.terms)} AND len(list_intersect(places, [{places}])) > 0
               AS hit
        FROM risks"""


@query(
    f"""
    WITH {RISKS_SQL}, verdicts AS ({" UNION ALL ".join(map(_finding_sql, FINDINGS))})
    SELECT report_id, label, expected, bool_or(hit) AS found,
           len(list_distinct(flatten(coalesce(list(cited) FILTER (WHERE hit), [])))) AS covered,
           coalesce(string_agg(DISTINCT title, '|' ORDER BY title) FILTER (WHERE hit), '') AS titles
    FROM verdicts GROUP BY 1, 2, 3
    """
)
def report_findings(spark, folder):
    found = findings_found(risk_texts(reports(spark, folder)), FINDINGS)
    return found.withColumn("titles", F.array_join("titles", "|"))


def _labels_sql(rules: list[tuple[str, str, object]]) -> str:
    shown = " UNION ALL ".join(
        f"SELECT report_id, CASE WHEN {_terms_sql(column, terms)} THEN '{label}' END AS label FROM risks"
        for label, column, terms in rules
    )
    return f"""
    WITH {RISKS_SQL}, matched AS ({shown})
    SELECT report_id, coalesce(string_agg(DISTINCT label, '|' ORDER BY label), '') AS labels
    FROM matched GROUP BY 1
    """


@query(_labels_sql([(x.label, "doubts" if x.only_uncertainties else "words", x.terms) for x in LINKS]))
def report_links(spark, folder):
    found = links_found(risk_texts(reports(spark, folder)), LINKS)
    return found.withColumn("labels", F.array_join("labels", "|"))


@query(_labels_sql([(x.label, "headline", x.terms) for x in DISTRACTORS]))
def report_distractors(spark, folder):
    found = distractors_found(risk_texts(reports(spark, folder)), DISTRACTORS)
    return found.withColumn("labels", F.array_join("labels", "|"))


@query(
    f"""
    WITH {RISKS_SQL}, joined AS (
        SELECT report_id, {MATCH_FORM.format("string_agg(words, chr(10) ORDER BY risk_pos)")} AS text
        FROM raw_risks GROUP BY 1
    )
    SELECT d.doc_id AS report_id,
           CASE WHEN doc_id % 50 = (doc_id * 7) % 50 THEN CAST(doc_id % 10 = 9 AS INTEGER)
                ELSE CAST(doc_id % 10 = 9 AS INTEGER) + CAST((doc_id * 7) % 10 = 9 AS INTEGER) END
           AS foreign_sources,
           'grundschule' || CASE WHEN contains(j.text, 'schkeit') THEN '|schkeit' ELSE '' END
           AS foreign_terms
    FROM documents d JOIN joined j ON d.doc_id = j.report_id
    """
)
def report_isolation(spark, folder):
    found = isolation(reports(spark, folder), FOREIGN)
    return found.withColumn("foreign_terms", F.array_join("foreign_terms", "|"))


@query(
    """
    SELECT doc_id AS report_id, 2 AS risks, 3 AS facts, 4 AS evidence,
           CAST(length(trim(substr(text, 1, 30))) < 20 AS INTEGER)
           + CAST(length(trim(substr(text, 20, 30))) < 20 AS INTEGER)
           + CAST(length(trim(substr(text, 100, 30))) < 20 AS INTEGER)
           + CAST(length(trim(substr(text, 12, 30))) < 20 AS INTEGER) AS short_excerpts,
           CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 2 END AS risks_without_conclusion
    FROM documents
    """
)
def report_sizes(spark, folder):
    return report_figures(reports(spark, folder))


@query(
    """
    WITH cited AS (
        SELECT doc_id, 'q' || CAST(doc_id % 50 AS VARCHAR) AS a,
               'q' || CAST((doc_id * 7) % 50 AS VARCHAR) AS b FROM documents
    )
    SELECT doc_id AS report_id, CASE WHEN a = b THEN a WHEN a < b THEN a || ',' || b
           ELSE b || ',' || a END AS cited
    FROM cited
    """
)
def cited_ids(spark, folder):
    return cited_sources(reports(spark, folder)).withColumn("cited", F.array_join("cited", ","))


@query(
    """
    SELECT doc_id AS report_id, risk_pos, fact_pos, evidence_pos,
           'q' || CAST((doc_id * factor) % 50 AS VARCHAR) AS chunk_id, substr(text, start, 30) AS excerpt
    FROM documents, (VALUES (0, 0, 0, 1, 1), (0, 0, 1, 7, 20), (0, 1, 0, 1, 100), (1, 0, 0, 7, 12))
         v(risk_pos, fact_pos, evidence_pos, factor, start)
    """
)
def evidence_rows(spark, folder):
    return explode_evidence(reports(spark, folder)).select(
        "report_id", "risk_pos", "fact_pos", "evidence_pos", "chunk_id", "excerpt"
    )


RULES = {
    "permit": (("keit", "tion"), ("nicht", "the ")),
    "number": (("1", "12"),),
}
_FORM = MATCH_FORM.format("text")


@query(
    f"""
    SELECT doc_id,
           (contains(m, 'keit') OR contains(m, 'tion')) AND (contains(m, 'nicht') OR contains(m, 'the '))
               AS permit,
           regexp_matches(m, '(^|[^0-9])1') OR regexp_matches(m, '(^|[^0-9])12') AS number
    FROM (SELECT doc_id, {_FORM} AS m FROM documents)
    """
)
def term_rules(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", match_form(F.col("text")).alias("m"))
    return documents.select(
        "doc_id", *[matches_terms(F.col("m"), terms).alias(name) for name, terms in RULES.items()]
    )


# ---------------------------------------------------------------- retrieval quality

METHODS = ("short", "long", "even")
FOUND_SQL = """
    expected AS (
        SELECT d.source AS label, d.lang AS kind, d.doc_id FROM documents d
        JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1
    ), found AS (
        SELECT source AS label, lang AS kind, doc_id, 'short' AS method FROM documents
        WHERE n_chars < 1000
        UNION ALL SELECT source, lang, doc_id, 'long' FROM documents WHERE n_chars >= 3000
        UNION ALL SELECT source, lang, doc_id, 'even' FROM documents WHERE n_chars % 2 = 0
    ), scored AS (
        SELECT m.method, e.label, e.kind, count(f.doc_id) AS hits, count(*) AS expected,
               count(f.doc_id) / count(*) AS recall
        FROM expected e CROSS JOIN (VALUES ('short'), ('long'), ('even')) m(method)
        LEFT JOIN found f ON f.method = m.method AND f.doc_id = e.doc_id GROUP BY 1, 2, 3
    )"""


def recalls(spark, folder):
    documents = table(spark, folder, "documents").select(
        F.col("source").alias("label"), F.col("lang").alias("kind"), "doc_id", "n_chars"
    )
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    expected = documents.join(good, "doc_id")
    length = F.col("n_chars")
    methods = F.array(
        F.when(length < 1000, F.lit("short")),
        F.when(length >= 3000, F.lit("long")),
        F.when(length % 2 == 0, F.lit("even")),
    )
    found = documents.withColumn("method", F.explode(F.array_compact(methods)))
    return recall(found, expected, ["doc_id"], ["label", "kind"], METHODS)


@query(f"WITH {FOUND_SQL} SELECT method, label, kind, hits, expected, round(recall, 9) AS recall FROM scored")
def recall_at_k(spark, folder):
    return recalls(spark, folder).withColumn("recall", F.round("recall", 9))


@query(
    f"""
    WITH {FOUND_SQL}
    SELECT method, kind, round(avg(recall), 9) AS mean_recall, count(*) AS cases FROM scored
    GROUP BY GROUPING SETS ((method, kind), (method))
    """
)
def macro_recall(spark, folder):
    return macro_average(recalls(spark, folder)).withColumn("mean_recall", F.round("mean_recall", 9))
