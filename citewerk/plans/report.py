"""Risk reports: evidence, one generator call, machine-checked citations.

The language model is a callable handed in by the caller. Spark collects the evidence
and validates every answer; an answer that stays invalid after the allowed repairs
gives no report at all.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewerk.functions.compounds import NO_PARTS, Parts
from citewerk.functions.ids import is_project_id, require_project_id
from citewerk.functions.text import citation, collapse_whitespace
from citewerk.functions.vectors import Encoder
from citewerk.operators.evidence import (
    check_citations,
    chronological,
    collect_evidence,
    explode_evidence,
    problems,
    shape_problems,
    source_blocks,
    value_problems,
)
from citewerk.operators.postings import Inverted
from citewerk.schemas import ANALYSIS, CHUNKS, REPORT
from citewerk.settings import EMBEDDING_DIM, GENERATOR_RETRIES
from citewerk.sources import storage

#: Short default; a caller passes own instructions for its model.
INSTRUCTIONS = (
    "Nenne Risiken als JSON {\"risks\": [...]} nach dem Schema der Analyse. Jeder Fakt führt die id "
    "seiner <quelle> und daraus ein wörtliches Zitat an."
)
#: Levels from the heaviest down.
LEVELS_BY_WEIGHT = ("hoch", "mittel", "niedrig")

# The levels a caller may ask for, empty for the model's own default.
THINKING = {"aus": False, "low": "low", "medium": "medium", "high": "high"}


class NoValidReport(RuntimeError):
    """The generator's answers stayed invalid after all repairs."""


@dataclass(frozen=True)
class Reply:
    """A generator's answer and what it cost."""

    text: str
    model_name: str = ""
    input_tokens: int = 0
    output_tokens: int = 0


Generator = Callable[[str, str, list[str]], Reply]
"""(instructions, prompt, problems of the previous answer) -> Reply"""


def parse_thinking(value: str) -> bool | str | None:
    if value and value not in THINKING:
        raise ValueError(f"Unbekannte Denkstufe {value!r}; möglich sind {', '.join(THINKING)}")
    return THINKING.get(value)


def validate_answer(spark: SparkSession, text: str, sources: DataFrame, project_id: str) -> list[str]:
    """Problems of one answer: its shape first, then every citation."""
    answer = spark.createDataFrame([(text,)], "text string").withColumn(
        "analysis", F.from_json("text", ANALYSIS)
    )
    shape = answer.select(shape_problems(F.col("text"), F.col("analysis"))).first()[0]
    if shape:
        return list(shape)
    reports = answer.select(F.lit("answer").alias("report_id"), F.col("analysis.risks").alias("risks"))
    checked = check_citations(explode_evidence(reports), sources, project_id)
    return [row.message for row in problems(checked).collect()]


def analyze(
    chunks: DataFrame,
    *,
    project_id: str,
    generator: Generator,
    retries: int = GENERATOR_RETRIES,
    now: datetime | None = None,
    instructions: str = INSTRUCTIONS,
) -> dict:
    """A checked risk report over the delivered chunks, as a dict of the report schema.

    The chunks are the evidence of one project (a few hundred at most by construction
    of `collect_evidence`); they become the prompt, so they pass through the driver.
    """
    require_project_id(project_id)
    spark = chunks.sparkSession
    rows = chronological(chunks.select(*CHUNKS.fieldNames())).collect()
    foreign = sorted({r.project_id for r in rows} - {project_id})
    if foreign:
        raise ValueError(f"Chunks aus fremden Projekten übergeben: {foreign}")
    created = now or datetime.now(UTC)
    stats = dict.fromkeys(("provided_chunks", "requests", "retries", "input_tokens", "output_tokens"), 0)
    report = {
        "project_id": project_id,
        "created_at": created,
        "model_name": "",
        "stats": {**stats, "seconds": 0.0},
        "risks": [],
        "sources": {},
    }
    if not rows:
        return report

    sources = spark.createDataFrame(rows, CHUNKS)
    blocks = {r.chunk_id: r.block for r in source_blocks(sources).collect()}
    prompt = f"Projekt {project_id}. Quellen:\n\n" + "\n\n".join(blocks[r.chunk_id] for r in rows)
    stats["provided_chunks"] = len(rows)
    started = time.perf_counter()
    found: list[str] = []
    for attempt in range(retries + 1):
        reply = generator(instructions, prompt, found)
        stats["requests"] += 1
        stats["retries"] = attempt
        stats["input_tokens"] += reply.input_tokens
        stats["output_tokens"] += reply.output_tokens
        found = validate_answer(spark, reply.text, sources, project_id)
        if not found:
            break
    else:
        raise NoValidReport("Ungültige Belege nach allen Nachbesserungen:\n- " + "\n- ".join(found))

    risks = json.loads(reply.text)["risks"]
    for risk in risks:
        risk.setdefault("conclusions", [])
        risk.setdefault("uncertainties", [])
    cited = sorted({e["chunk_id"] for r in risks for f in r["facts"] for e in f["evidence"]})
    by_id = {r.chunk_id: r.asDict() for r in rows}
    return {
        **report,
        "model_name": reply.model_name,
        "stats": {**stats, "seconds": round(time.perf_counter() - started, 1)},
        "risks": risks,
        "sources": {chunk_id: by_id[chunk_id] for chunk_id in cited},
    }


def create_report(
    index: DataFrame,
    *,
    project_id: str,
    encoder: Encoder,
    generator: Generator,
    retries: int = GENERATOR_RETRIES,
    dim: int = EMBEDDING_DIM,
    lexicon: Parts = NO_PARTS,
    inverted: Inverted | None = None,
) -> dict:
    evidence = collect_evidence(
        index, project_id=project_id, encoder=encoder, dim=dim, lexicon=lexicon, inverted=inverted
    )
    return analyze(evidence, project_id=project_id, generator=generator, retries=retries)


# ---------------------------------------------------------------- storage


def to_json(report: dict) -> str:
    def shown(value: object) -> str:
        return value.isoformat()

    return json.dumps(report, ensure_ascii=False, indent=2, default=shown)


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stored reports, one row each, keyed by the path of their file. An invalid one is an error."""
    reader = spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST")
    reports = reader.json(paths).withColumn("report_id", F.input_file_name())
    complete = [F.col(c).isNotNull() for c in ("created_at", "model_name", "stats", "sources")]
    sound = is_project_id(F.col("project_id")) & (F.size(value_problems(F.col("risks"))) == 0)
    for present in complete:
        sound = sound & present
    broken = reports.where(~F.coalesce(sound, F.lit(False))).select("report_id").take(5)
    if broken:
        raise ValueError(f"Ungültige Berichte: {', '.join(r.report_id for r in broken)}")
    return reports


def report_stem(model: str, started: datetime, thinking: str | None = None) -> str:
    """File name without suffix: time, model and thinking level."""
    shown = re.sub("[^A-Za-z0-9._-]+", "-", model).strip("-")
    level = f"_denken-{thinking}" if thinking else ""
    return f"risikobericht_{started:%Y%m%d-%H%M}_{shown}{level}"


def write_report(spark: SparkSession, report: dict, target_dir: str, stem: str) -> tuple[str, str]:
    """The report for evaluation (JSON) and for reading (text); returns both paths, text first."""
    base = f"{target_dir}/{report['project_id']}/{stem}"
    storage.write_text(spark, f"{base}.json", to_json(report))
    stored = spark.read.schema(REPORT).option("multiLine", True).json(f"{base}.json")
    storage.write_text(spark, f"{base}.txt", readable(stored).first().text + "\n")
    return f"{base}.txt", f"{base}.json"


# ---------------------------------------------------------------- text for readers


def _rank(level: Column) -> Column:
    """Place of a level in LEVELS_BY_WEIGHT."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS_BY_WEIGHT]), level)


def readable(reports: DataFrame) -> DataFrame:
    """Reports as plain text (`text`): heaviest risks first, each fact with its sources.

    Everything is in the report's own row, so this is a projection.
    """
    sources = F.col("sources")

    def cited(evidence: Column) -> Column:
        source = sources[evidence["chunk_id"]]
        place = citation(
            source["project_id"], source["file_name"], source["locator"], source["document_date"]
        )
        return F.concat(F.lit("    „"), collapse_whitespace(evidence["excerpt"]), F.lit("“ – "), place)

    def fact_lines(fact: Column) -> Column:
        head = F.array(F.concat(F.lit("  * "), fact["statement"]))
        return F.concat(head, F.array_distinct(F.transform(fact["evidence"], cited)))

    def listed(mark: str, entries: Column) -> Column:
        return F.transform(entries, lambda e: F.concat(F.lit(f"  {mark} "), e))

    def risk_lines(risk: Column) -> Column:
        head = F.concat_ws(" | ", *[risk[k] for k in ("title", "severity", "probability", "status", "owner")])
        body = F.array(
            F.lit(""), head, risk["description"], F.concat(F.lit("Folge: "), risk["impact"]),
            F.concat(F.lit("Vorgehen: "), risk["measure"]),
        )
        facts = F.flatten(F.transform(risk["facts"], fact_lines))
        return F.concat(body, facts, listed("=>", risk["conclusions"]), listed("?", risk["uncertainties"]))

    placed = F.transform(
        "risks", lambda r, i: F.struct(_rank(r["severity"]), _rank(r["probability"]), i, r.alias("risk"))
    )
    ordered = F.transform(F.array_sort(placed), lambda p: p["risk"])
    title = F.format_string(
        "Risiken in %s, %s, %d Textstellen, %d Risiken",
        F.col("project_id"), F.date_format("created_at", "yyyy-MM-dd HH:mm"),
        F.col("stats.provided_chunks"), F.size("risks"),
    )
    lines = F.concat(F.array(title), F.flatten(F.transform(ordered, risk_lines)))
    return reports.withColumn("text", F.array_join(lines, "\n"))
