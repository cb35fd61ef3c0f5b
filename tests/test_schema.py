"""Events of several kinds against their fields."""

import json

from vellum.functions import schema

EVENTS = {
    '{"type":"stage","stage":"parse","at":1}': [],
    '{"type":"stage","stage":"lunch","at":"1"}': [("$.stage", "value"), ("$.at", "type")],
    '{"type":"finding","finding":{"id":"f","severity":"low","fix":null}}': [],
    '{"type":"finding","finding":{"id":7,"severity":"low","fix":[]}}': [("$.finding.id", "type"), ("$.finding.fix", "type")],
    '{"type":"finding","finding":"f"}': [("$.finding", "type"), ("$.finding.id", "missing"), ("$.finding.severity", "missing")],
    '{"type":"aggregate","overallScore":1.5,"keywordMap":[{"a":1}]}': [],
    '{"type":"aggregate","overallScore":true,"keywordMap":{}}': [("$.overallScore", "type"), ("$.keywordMap", "type")],
    '{"type":"done","at":1e3}': [], '{"type":"done"}': [("$.at", "missing")], '{"type":"other","at":1}': [("$.type", "kind")], '{"at":1}': [("$.type", "kind")],
    "[1]": [("$", "syntax")], "3": [("$", "syntax")], '{"type":"done","at":': [("$", "syntax")], "": [("$", "syntax")],
}


def test_each_error_is_named(spark):
    rows = spark.createDataFrame([(i, t, "own") for i, t in enumerate([*EVENTS, None])], "i int, json string, reason string").drop("reason")
    found = schema.checked(rows, "json").cache()
    got = {r.json: [(e.path, e.reason) for e in r.errors] for r in found.collect()}
    assert got == EVENTS | {None: [("$", "syntax")]}
    assert all(r.kind == (json.loads(r.json)["type"] if r.json and not {("$", "syntax"), ("$.type", "kind")} & set(got[r.json]) else None) for r in found.collect())
    # Valid and rejected events are all of them.
    wrong = {r.i for r in schema.rejected(found).collect()}
    assert wrong | {r.i for r in found.filter("size(errors) = 0").collect()} == set(range(len(EVENTS) + 1)) and len(wrong) == len([e for e in EVENTS.values() if e]) + 1
    assert schema.checked(rows.limit(0), "json").count() == 0
