"""Evidence: collecting what may be cited, and checking what was cited."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewerk.functions.compounds import NO_PARTS, Parts
from citewerk.functions.ids import require_project_id
from citewerk.functions.text import is_quoted, source_element
from citewerk.functions.vectors import Encoder
from citewerk.operators.postings import Inverted
from citewerk.operators.retrieval import fetch_chunks, hybrid_hits
from citewerk.schemas import CHUNK_COLUMNS, LEVELS, RISK_CATEGORIES, RISK_STATUSES, RISK_TEXT_FIELDS
from citewerk.settings import CANDIDATES_PER_METHOD, EMBEDDING_DIM, HITS_PER_QUESTION

# One general question, then one per risk category.
RISK_QUESTIONS = (
    "Welche Risiken gefährden den Baubeginn oder die Fertigstellung?",
    "Welche Termine, Meilensteine oder Fristen sind verzögert oder gefährdet?",
    "Welche Nachträge, Mehrkosten oder Budgetüberschreitungen sind offen?",
    "Welche Genehmigungen, Auflagen oder Nachweise fehlen noch?",
    "Welche Pläne, Planfreigaben oder Entscheidungen fehlen oder sind verspätet?",
    "Welche Mängel, Prüfungen oder Qualitätsprobleme sind ungeklärt?",
    "Welche vertraglichen Streitpunkte, Behinderungen oder offenen Beauftragungen gibt es?",
    "Wo fehlen Personal, Geräte oder Kapazitäten?",
    "Welche Lieferungen, Hersteller oder Nachunternehmer sind verzögert?",
    "Wo sind Zuständigkeiten zwischen Beteiligten ungeklärt?",
)


def chronological(rows: DataFrame) -> DataFrame:
    """Oldest first, undated before all; the order in which evidence is delivered."""
    return rows.orderBy(F.asc_nulls_first("document_date"), "file_name", "index", "chunk_id")


def collect_evidence(
    index: DataFrame,
    *,
    project_id: str,
    encoder: Encoder,
    questions: Sequence[str] = RISK_QUESTIONS,
    hits_per_question: int = HITS_PER_QUESTION,
    candidates: int = CANDIDATES_PER_METHOD,
    dim: int = EMBEDDING_DIM,
    lexicon: Parts = NO_PARTS,
    stops: Collection[str] | None = None,
    inverted: Inverted | None = None,
) -> DataFrame:
    """Chunks found by any of the questions, each once, in chronological order.

    All questions share one scan per method instead of one search each.
    """
    require_project_id(project_id)
    hits = hybrid_hits(
        index, project_id, questions, encoder, hits_per_question, candidates, dim, lexicon, stops, inverted
    )
    ids = hits.select("chunk_id").distinct()
    found = fetch_chunks(index, project_id, ids, len(questions) * hits_per_question)
    return chronological(found.select(*CHUNK_COLUMNS))


def source_blocks(chunks: DataFrame) -> DataFrame:
    """chunk_id and the tagged block in which a chunk is handed to a generator."""
    return chunks.select(
        "chunk_id",
        source_element(
            *[F.col(c) for c in ("chunk_id", "file_name", "doc_type", "locator")],
            F.col("document_date"),
            F.col("heading"),
            F.col("text"),
        ).alias("block"),
    )


def explode_evidence(reports: DataFrame, key: str = "report_id") -> DataFrame:
    """One row per cited excerpt of reports with a `risks` array, positions from 0."""
    return (
        reports.select(key, F.posexplode("risks").alias("risk_pos", "risk"))
        .select(key, "risk_pos", F.col("risk.title").alias("title"), F.posexplode("risk.facts"))
        .withColumnsRenamed({"pos": "fact_pos", "col": "fact"})
        .select(
            key,
            "risk_pos",
            "fact_pos",
            "title",
            F.col("fact.statement").alias("statement"),
            F.posexplode("fact.evidence").alias("evidence_pos", "evidence"),
        )
        .select(
            key,
            "risk_pos",
            "fact_pos",
            "evidence_pos",
            "title",
            "statement",
            F.col("evidence.chunk_id").alias("chunk_id"),
            F.col("evidence.excerpt").alias("excerpt"),
        )
    )


def problem_of(
    chunk_id: Column, excerpt: Column, project_id: Column, delivered: Column, own: Column, quoted: Column
) -> Column:
    """First thing wrong with a citation, NULL if nothing is; NULL ids and excerpts are wrong."""
    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    shown = F.concat(F.lit("'"), F.coalesce(chunk_id, F.lit("")), F.lit("'"))
    owner = F.coalesce(project_id, F.lit(""))
    return (
        F.when(
            ~holds(delivered), F.concat(F.lit("Quelle "), shown, F.lit(" wurde nicht geliefert."))
        )
        .when(~holds(own), F.concat(F.lit("Quelle "), shown, F.lit(" gehört nicht zu "), owner, F.lit(".")))
        .when(
            ~holds(quoted),
            F.concat(
                F.lit("Der Auszug „"), F.coalesce(excerpt, F.lit("")), F.lit("“ steht nicht wörtlich in Quelle "), shown,
                F.lit("."),
            ),
        )
    )


def check_citations(evidence: DataFrame, sources: DataFrame, project_id: Column | str) -> DataFrame:
    """Evidence rows with `problem`: not delivered, of another project, or not verbatim.

    `sources` are the delivered chunks; only those that are cited at all take part in the
    join. Evidence of hot chunks is safe: chunk_id is unique on the source side and AQE
    splits a skewed evidence side.
    """
    owner = F.lit(project_id) if isinstance(project_id, str) else project_id
    cited = evidence.select("chunk_id").distinct()
    delivered = sources.join(cited, "chunk_id", "left_semi").select(
        F.col("chunk_id"),
        F.col("project_id").alias("_source_project"),
        F.col("heading").alias("_heading"),
        F.col("text").alias("_text"),
    )
    return (
        evidence.join(delivered, "chunk_id", "left")
        .withColumn(
            "problem",
            problem_of(
                F.col("chunk_id"),
                F.col("excerpt"),
                owner,
                F.col("_text").isNotNull(),
                F.col("_source_project") == owner,
                is_quoted(F.col("excerpt"), F.col("_heading"), F.col("_text")),
            ),
        )
        .drop("_source_project", "_heading", "_text")
    )


def problems(checked: DataFrame) -> DataFrame:
    """The readable problem list, in the order of the analysis."""
    title, statement = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "statement"))
    where = F.concat(F.lit("Risiko „"), title, F.lit("“, Fakt „"), statement, F.lit("“: "))
    return (
        checked.where(F.col("problem").isNotNull())
        .withColumn("message", F.concat(where, F.col("problem")))
        .orderBy("risk_pos", "fact_pos", "evidence_pos")
    )


# ---------------------------------------------------------------- shape of an analysis

RISK_KEYS = (*RISK_TEXT_FIELDS, "facts", "conclusions", "uncertainties")
OPTIONAL_KEYS = ("conclusions", "uncertainties")


def _violated(rules: Sequence[tuple[Column, str]]) -> Column:
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for ok, m in rules])
    return F.filter(found, lambda m: m.isNotNull())


def value_problems(risks: Column) -> Column:
    """array<string> of violations that can be seen on parsed risks: missing texts, values
    outside their enumeration, facts without evidence."""
    complete = F.forall(
        risks,
        lambda r: F.forall(F.array(*[r[k] for k in RISK_TEXT_FIELDS]), lambda v: v.isNotNull()),
    )
    enumerations = F.forall(
        risks,
        lambda r: r["category"].isin(*RISK_CATEGORIES)
        & r["probability"].isin(*LEVELS)
        & r["severity"].isin(*LEVELS)
        & r["status"].isin(*RISK_STATUSES),
    )
    supported = F.forall(
        risks,
        lambda r: (F.coalesce(F.size(r["facts"]), F.lit(0)) > 0)
        & F.forall(r["facts"], lambda f: F.coalesce(F.size(f["evidence"]), F.lit(0)) > 0),
    )
    return _violated(
        [
            (complete, "Pflichtfeld ohne Text"),
            (enumerations, "Wert außerhalb der Aufzählung"),
            (supported, "Fakt ohne Beleg"),
        ]
    )


def _object(**fields: str) -> str:
    """Pattern of a variant schema with any of the fields, each of its type."""
    return "OBJECT<((" + "|".join(f"{k}: {v}" for k, v in sorted(fields.items())) + ")(, )?)*>"


def _array(element: str) -> str:
    return f"ARRAY<(VOID|{element})>"


_EVIDENCE = _array(_object(chunk_id="STRING", excerpt="STRING"))
_FACTS = _array(_object(statement="STRING", evidence=_EVIDENCE))
_LISTS = dict.fromkeys(OPTIONAL_KEYS, _array("STRING"))
_RISKS = _array(_object(**dict.fromkeys(RISK_TEXT_FIELDS, "STRING"), facts=_FACTS, **_LISTS))
_TYPES = f"^OBJECT<answer: OBJECT<(.*, )?risks: {_RISKS}(, .*)?>, closed: STRING>$"


def _nothing_null(objects: Column, risks: Column) -> Column:
    """No NULL in place of a risk, a field, a list entry or a citation."""

    def all_set(values: Column) -> Column:
        return F.forall(values, lambda v: v.isNotNull())

    def lists_set(risk: Column) -> Column:
        lists = F.array(risk["conclusions"], risk["uncertainties"])
        return F.forall(lists, lambda part: F.coalesce(all_set(part), F.lit(True)))

    def fact_set(fact: Column) -> Column:
        return fact["statement"].isNotNull() & F.forall(
            fact["evidence"],
            lambda e: e.isNotNull() & e["chunk_id"].isNotNull() & e["excerpt"].isNotNull(),
        )

    return F.forall(objects, lambda o: all_set(F.map_values(o))) & F.forall(
        risks, lambda r: r.isNotNull() & lists_set(r) & F.forall(r["facts"], fact_set)
    )


def shape_problems(json_text: Column, parsed: Column) -> Column:
    """array<string> of violations: malformed JSON, missing or unknown keys, values
    outside their enumeration, facts without evidence.

    `from_json` drops unknown keys and fills missing ones with NULL, so the keys are
    read from the text again, as maps of raw JSON values.
    """
    objects = F.from_json(json_text, "struct<risks:array<map<string,string>>>")["risks"]
    top = F.from_json(json_text, "map<string,string>")
    risks = parsed["risks"]

    def keys_ok(entry: Column, required: Sequence[str], optional: Sequence[str] = ()) -> Column:
        names = F.map_keys(entry)
        known = F.array(*[F.lit(k) for k in (*required, *optional)])
        needed = F.array(*[F.lit(k) for k in required])
        return (F.size(F.array_except(names, known)) == 0) & (
            F.size(F.array_except(needed, names)) == 0
        )

    def nested(entry: Column) -> Column:
        return F.from_json(
            entry["facts"], "array<struct<evidence:array<map<string,string>>>>"
        )

    def fact_maps(entry: Column) -> Column:
        return F.from_json(entry["facts"], "array<map<string,string>>")

    required = [k for k in RISK_KEYS if k not in OPTIONAL_KEYS]
    risk_keys = F.forall(objects, lambda o: keys_ok(o, required, OPTIONAL_KEYS))
    fact_keys = F.forall(
        objects, lambda o: F.forall(fact_maps(o), lambda f: keys_ok(f, ("statement", "evidence")))
    )
    evidence_keys = F.forall(
        objects,
        lambda o: F.forall(
            nested(o),
            lambda f: F.forall(f["evidence"], lambda e: keys_ok(e, ("chunk_id", "excerpt"))),
        ),
    )
    # The schema of a variant names every type. Parsing stops after the first value, so the text
    # is put before a further field, which only a text that is JSON to its end leaves readable.
    whole = F.try_parse_json(F.concat(F.lit('{"answer":'), json_text, F.lit(',"closed":"yes"}')))
    kinds = F.schema_of_variant(whole).rlike(_TYPES)
    values = value_problems(risks)
    rules = [
        (keys_ok(top, ("risks",)) & risks.isNotNull(), "kein Objekt mit genau dem Feld risks"),
        (
            risk_keys & fact_keys & evidence_keys & kinds & _nothing_null(objects, risks),
            "fehlende oder unbekannte Felder",
        ),
    ]
    return F.concat(_violated(rules), values)
