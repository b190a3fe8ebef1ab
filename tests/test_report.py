"""Answers of a generator: what passes the checks, what is repaired, and what a report says."""

import copy
import hashlib
import json
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from citewerk.operators import evaluation as ev
from citewerk.operators.evidence import source_blocks
from citewerk.plans.evaluation import ReportRules, score_reports
from citewerk.plans.report import (
    NoValidReport,
    Reply,
    analyze,
    parse_thinking,
    read_reports,
    readable,
    report_stem,
    validate_answer,
    write_report,
)
from citewerk.schemas import CHUNKS, REPORT

PROJECT = "HAF-7"


def source(number, text, project=PROJECT, heading="Kranbahn"):
    """A delivered chunk of an inspection report of a harbour."""
    key = hashlib.md5(f"{project}/{number}".encode()).hexdigest()
    name = f"pruefung_{number}.pdf"
    return (
        key, key[::-1], key, project, number, text, 0, len(text), f"{project}/berichte/{name}", name,
        "sonstiges", date(2025, 3, number), number, f"S. {number}", heading,
    )


RAIL = source(1, "Schiene 3 ist abgenutzt.\nDer Austausch ist für Mai   geplant.")
BOLT = source(2, "Am Lager 12 fehlen zwei Schrauben.")
OTHER = source(3, "Die Schiene ist neu.", "HAF-8")
QUOTE = {"chunk_id": RAIL[0], "excerpt": "Schiene 3 ist abgenutzt."}


def answer(*evidence, **fields):
    """One risk as a generator would write it."""
    risk = dict.fromkeys(
        ("title", "description", "project_area", "impact", "owner", "measure"), "Kranbahn gesperrt"
    )
    risk |= {"category": "qualität", "probability": "mittel", "severity": "niedrig", "status": "offen"}
    risk["facts"] = [{"statement": "Die Schiene ist verschlissen.", "evidence": list(evidence or [QUOTE])}]
    return risk | {"conclusions": [], "uncertainties": []} | fields


def as_text(*risks):
    return json.dumps({"risks": list(risks)}, ensure_ascii=False)


class Model:
    """Gives its answers in turn and keeps what it was told."""

    def __init__(self, *texts):
        self.texts, self.told = list(texts), []

    def __call__(self, instructions, prompt, problems):
        self.told.append((instructions, prompt, list(problems)))
        return Reply(self.texts[min(len(self.told), len(self.texts)) - 1], "m", 7, 3)


@pytest.fixture(scope="module")
def chunks(spark):
    return lambda *rows: spark.createDataFrame(list(rows), CHUNKS)


def test_good_answer(spark, chunks):
    assert validate_answer(spark, as_text(answer()), chunks(RAIL, BOLT), PROJECT) == []


@pytest.mark.parametrize(
    ("evidence", "said"),
    [
        ({"chunk_id": RAIL[0], "excerpt": "abgenutzt. Der Austausch ist für Mai geplant"}, None),
        ({"chunk_id": RAIL[0], "excerpt": "Kranbahn"}, None),
        ({"chunk_id": RAIL[0], "excerpt": "Schiene 4"}, "wörtlich"),
        ({"chunk_id": RAIL[0], "excerpt": "\n"}, "wörtlich"),
        ({"chunk_id": "nirgends", "excerpt": "Schiene"}, "nicht geliefert"),
        ({"chunk_id": OTHER[0], "excerpt": "Die Schiene ist neu."}, PROJECT),
        ({"chunk_id": None, "excerpt": "Schiene"}, "Felder"),
        ({"chunk_id": RAIL[0], "excerpt": None}, "Felder"),
        (None, "Felder"),
    ],
)
def test_one_citation(spark, chunks, evidence, said):
    found = validate_answer(spark, as_text(answer(evidence)), chunks(RAIL, BOLT, OTHER), PROJECT)
    if evidence is None:
        found = validate_answer(spark, as_text(answer(QUOTE, None)), chunks(RAIL), PROJECT)
    assert bool(found) == bool(said)
    assert all(isinstance(p, str) for p in found) and (not said or said in found[0])


@pytest.mark.parametrize(
    "change",
    [
        {"title": 5}, {"title": None}, {"title": {"a": 1}}, {"conclusions": None}, {"conclusions": [None]},
        {"uncertainties": [1]}, {"facts": None}, {"facts": [None]}, {"facts": []}, {"facts": "x"},
        {"facts": [{"statement": None, "evidence": [QUOTE]}]}, {"facts": [{"statement": 1, "evidence": [QUOTE]}]},
        {"facts": [{"statement": "s", "evidence": []}]}, {"facts": [{"statement": "s", "evidence": [QUOTE | {"x": 1}]}]},
        {"severity": "sehr hoch"}, {"note": "n"},
    ],
)
def test_wrong_shapes(spark, chunks, change):
    assert validate_answer(spark, as_text(answer(**change)), chunks(RAIL), PROJECT)


def test_wrong_texts(spark, chunks):
    good = as_text(answer())
    for text in (good + " fertig", good[:-1], "[]", "", '{"risks": null}', '{"risks": [null]}', '{"risks": [], "x": 1}'):
        assert validate_answer(spark, text, chunks(RAIL), PROJECT), text
    short = answer()
    del short["conclusions"], short["uncertainties"]
    assert validate_answer(spark, as_text(short), chunks(RAIL), PROJECT) == []
    missing = copy.deepcopy(answer())
    del missing["owner"]
    assert validate_answer(spark, as_text(missing), chunks(RAIL), PROJECT)


def test_repairs(chunks):
    model = Model(as_text(answer({"chunk_id": None, "excerpt": None})), as_text(answer()) + "!", as_text(answer()))
    report = analyze(chunks(RAIL, BOLT), project_id=PROJECT, generator=model, instructions="kurz")
    assert (report["stats"]["requests"], report["stats"]["retries"], report["stats"]["input_tokens"]) == (3, 2, 21)
    assert list(report["sources"]) == [RAIL[0]] and report["stats"]["provided_chunks"] == 2
    assert model.told[0][0] == "kurz" and BOLT[0] in model.told[0][1]
    assert model.told[0][2] == [] and model.told[1][2] and model.told[2][2]
    with pytest.raises(NoValidReport):
        analyze(chunks(RAIL), project_id=PROJECT, generator=Model("nichts"), retries=1)


def test_before_any_question(spark, chunks):
    silent = Model()
    assert analyze(chunks(RAIL).limit(0), project_id=PROJECT, generator=silent)["risks"] == []
    for rows, project in ((chunks(RAIL, OTHER), PROJECT), (chunks(RAIL), "x/../y")):
        with pytest.raises(ValueError):
            analyze(rows, project_id=project, generator=silent)
    assert silent.told == []
    block = source_blocks(chunks(BOLT)).first().block
    assert BOLT[0] in block and "2025-03-02" in block and BOLT[5] in block


def test_thinking_and_names():
    assert [parse_thinking(v) for v in ("", "aus", "low")] == [None, False, "low"]
    with pytest.raises(ValueError):
        parse_thinking("tief")
    assert report_stem("a:b/c", datetime(2025, 1, 2, 3, 4), "low").endswith("20250102-0304_a-b-c_denken-low")


def stored(spark, folder, *answers):
    paths = []
    for n, text in enumerate(answers):
        rows = spark.createDataFrame([RAIL, BOLT], CHUNKS)
        now = datetime(2025, 4, 1, 8, 30, tzinfo=UTC)
        report = analyze(rows, project_id=PROJECT, generator=Model(text), now=now)
        paths.append(write_report(spark, report, f"{folder}/{n}", "gleich"))
    return paths


def test_stored_reports(spark, tmp_path):
    light = answer(title="Leicht", severity="niedrig")
    heavy = answer(QUOTE, {"chunk_id": BOLT[0], "excerpt": "zwei Schrauben"}, title="Schwer", severity="hoch",
                   uncertainties=["Umfang unklar"])
    paths = stored(spark, tmp_path, as_text(light, heavy), as_text())
    reports = read_reports(spark, [data for _, data in paths])
    assert reports.select("report_id").distinct().count() == 2  # same name, two folders
    written = open(paths[0][0], encoding="utf-8").read()
    assert written.index("Schwer | hoch") < written.index("Leicht | niedrig")
    assert "    „zwei Schrauben“ – HAF-7 · pruefung_2.pdf · S. 2 · 02.03.2025" in written
    assert "  ? Umfang unklar" in written and "2 Risiken" in written.splitlines()[0]

    rules = ReportRules(
        project_id=PROJECT,
        findings=[ev.Finding("F", (("schiene",),), frozenset({("pruefung_2.pdf", "S. 2"), ("x", "y")}))],
        links=[ev.Link("L", (("umfang",),), True), ev.Link("M", (("mond",),))],
        distractors=[ev.Distractor("D", (("kranbahn",),))],
        foreign_terms=["schrauben", "mond"],
    )
    full, empty = (score_reports(reports, rules).orderBy(F.desc("risks")).collect())
    verdict = full.findings[0]
    assert (verdict.found, verdict.covered, verdict.expected, verdict.titles) == (True, 1, 2, ["Schwer"])
    assert (full.links, full.distractors, full.foreign_terms) == (["L"], ["D"], ["schrauben"])
    assert (full.risks, full.facts, full.evidence, full.findings_found) == (2, 2, 3, 1)
    assert (empty.risks, empty.findings_found, empty.links, empty.distractors) == (0, 0, [], [])
    assert [f.found for f in empty.findings] == [False]
    plan = score_reports(reports, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

    # the grouped forms agree with the row's own
    risks = ev.risk_texts(reports)
    assert [r.found for r in ev.findings_found(risks, rules.findings).collect()] == [True]
    assert ev.links_found(risks, rules.links).first().labels == ["L"]
    assert ev.distractors_found(risks, rules.distractors).first().labels == ["D"]


def test_unreadable_report(spark, tmp_path):
    (tmp_path / "halb.json").write_text(json.dumps({"project_id": PROJECT, "risks": []}))
    with pytest.raises(ValueError, match="halb"):
        read_reports(spark, str(tmp_path / "halb.json"))
    assert readable(spark.createDataFrame([], REPORT)).count() == 0
