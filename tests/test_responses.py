"""Contract of classification responses."""

import json

import pytest

from minutary.operators import responses

TEXT = "请信息部 本周完成巡检。完成巡检。"
GOOD = {"label_code": "T", "schema_version": "v1", "segment_id": "s1", "primary_label": "task", "secondary_labels": ["report"], "event_hint": "CREATE", "route": "EXTRACT", "signals": {s: False for s in responses.SIGNALS}, "evidence": [{"text": "信息部", "start_char": 1, "end_char": 4}], "ambiguities": []}


def changed(**kw):
    return json.dumps({**GOOD, **kw}, ensure_ascii=False)


def without(name):
    return json.dumps({k: v for k, v in GOOD.items() if k != name}, ensure_ascii=False)


def piece(text, start=0, end=1, **more):
    return {"text": text, "start_char": start, "end_char": end, **more}


CASES = {
    "good": (json.dumps(GOOD), None),
    "fenced": ("```json\n" + json.dumps(GOOD) + "\n```", None),
    "text": ("no", "not_json"),
    "null": (None, "not_json"),
    "array": ("[1]", "not_object"),
    "more": (changed(extra=1), "<root>: unknown_field"),
    "less": (without("route"), "<root>: missing_field"),
    "two faults": (changed(route="x", event_hint="y"), "event_hint: not_allowed"),
    "hint": (changed(event_hint=None), "event_hint: not_allowed"),
    "no evidence": (changed(evidence=[]), "evidence: empty"),
    "evidence object": (changed(evidence={}), "evidence: not_array"),
    "evidence field": (changed(evidence=[piece("信息部", 1, 4), piece("x", more=1)]), "evidence.1: unknown_field"),
    "evidence start": (changed(evidence=[piece("信息部", -1, 4)]), "evidence.0.start_char: not_allowed"),
    "evidence end": (changed(evidence=[piece("", -1, "4")]), "evidence.0.end_char: not_allowed"),
    "evidence gone": (changed(evidence=[piece("信息部", 1, 4), piece("财务部")]), "evidence.1: no_clear_place"),
    "evidence twice": (changed(evidence=[piece("完成巡检", 0, 4)]), "evidence.0: no_clear_place"),
    "labels": (changed(secondary_labels=["report", "odd"]), "secondary_labels.1: not_allowed"),
    "labels twice": (changed(secondary_labels=["report", "report"]), "secondary_labels: repeated"),
    "version": (changed(schema_version="v0"), "schema_version: not_allowed"),
    "signal": (changed(signals={**GOOD["signals"], "negated": "no"}), "signals.negated: not_boolean"),
    "signals": (changed(signals={}), "signals: missing_field"),
    "ambiguity": (changed(ambiguities=[" "]), "ambiguities.0: not_allowed"),
    "order": (json.dumps(dict(sorted(GOOD.items()))), "label_code_not_first"),
    "segment": (changed(segment_id="s2"), "segment_mismatch"),
    "code": (changed(label_code="R"), "label_code_mismatch"),
    "repeat": (changed(secondary_labels=["task"]), "secondary_repeats_primary"),
}


@pytest.fixture(scope="module")
def answers(spark):
    more = {
        "moved": changed(evidence=[piece("信息部本周"), piece("信息部", 1, 4), piece("完成巡检", 7, 11)]),
        "notes": changed(ambiguities=[" which? ", {"text": "a", "reason": "b"}, {"field": "f", "description": "d"}, {"reason": "r", "field": ""}]),
    }
    rows = [(k, "s1", TEXT, raw) for k, raw in {**{k: raw for k, (raw, _) in CASES.items()}, **more}.items()]
    return {r["case"]: r for r in responses.checked(spark.createDataFrame(rows, "case string, segment_id string, clean_text string, raw string")).collect()}


def test_faults(answers):
    assert {k: answers[k].fault for k in CASES} == {k: f for k, (_, f) in CASES.items()}
    assert answers["good"].normalizations == [] and answers["code"].evidence is None


def test_evidence_and_notes_are_set_right(answers):
    r = answers["moved"]
    assert r.fault is None and [tuple(e) for e in r.evidence] == [("信息部 本周", 1, 7), ("信息部", 1, 4), ("完成巡检", 7, 11)] and r.normalizations == ["evidence_offset_recovered:0"]
    r = answers["notes"]
    assert [tuple(a) for a in r.ambiguities] == [("content", "which?"), ("content", "a：b"), ("f", "d"), ("content", "r")] and r.normalizations == ["ambiguity_fields_normalized"]
