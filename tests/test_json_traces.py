"""JSON traces: values as the notation has them, identities, blocks, diagnostics with places, hashes."""

import json

import pytest
from pyspark.sql import functions as F

from wayline.functions import json_values as J
from wayline.operators import generic, legacy, pairing


@pytest.mark.parametrize(
    ("text", "expected"),
    [("25000000.5", "25000000.5"), ("0.10", "0.1"), ("1e3", "1000"), ("1.0", "1"), ("-0.0", "0"), ("-12.50", "-12.5"), ("1e21", "1e+21"), ("123456789012345678901", "123456789012345680000"), ("9007199254740993", "9007199254740992"), ("0.000001", "0.000001"), ("1e-7", "1e-7"), ("1.5e-5", "0.000015"), ("1.25e+25", "1.25e+25"), ("5e-324", "5e-324"), ("1e400", "Infinity"), ("1e-400", "0")],
)
def test_numbers_read_as_shortest_decimals(text, expected):
    value = J.parse(text)
    assert J.tagged(value)[1] == expected and J.write([value]) == (f'["{expected}"]' if expected == "Infinity" else f"[{expected}]")


def test_written_values():
    assert J.write(J.parse('{"b":1e-7,"a":[1.0,"x\\u0001\\ud83d\\ude00\\ud800\\n"],"10":1,"2":null}')) == '{"2":null,"10":1,"b":1e-7,"a":[1,"x\\u0001😀\\ud800\\n"]}'
    mixed = J.parse('{"b":{"z":1,"A":2,"a":0,"a_b":3,"ab":4,"B":1,"a1":1},"a":[{"d":1,"c":2}]}')
    assert J.write(mixed, "units") == '{"a":[{"c":2,"d":1}],"b":{"A":2,"B":1,"a":0,"a1":1,"a_b":3,"ab":4,"z":1}}'
    assert J.write(mixed, "letters") == '{"a":[{"c":2,"d":1}],"b":{"a":0,"A":2,"a_b":3,"a1":1,"ab":4,"B":1,"z":1}}'
    for bad in ("", "{", "NaN", "[1,]", "01", "'a'"):
        with pytest.raises(ValueError):
            J.parse(bad)
    assert [J.tagged_count(J.parse(t)) for t in ("5", '" 7 "', '""', "1.0", '"0x10"', "true", "[]", "[3]", '"1e2"')] == [("n", n) for n in ("5", "7", "0", "1", "16", "1", "0", "3", "100")]
    assert [J.tagged_count(J.parse(t))[0] for t in ("-1", "1.5", '"a"', "{}", "[1,2]", "1e30")] == ["x"] * 6
    assert J.plain_text(J.parse('[{"type":"text","text":"hi"},"x",5,{"content":["a",{"b":1}]},null]')) == 'hi x 5 a {"b":1} null'
    assert J.tagged_field("  {bad") == ("x", "  {bad") and J.tagged_field(' {"a": 1.0}') == ("o", '{"a":1}')


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b": 1.50, "a": {"d": [1e3, {"y":1,"x":2}], "c": null}}',), (None,), ("plain",), ("[",), ("0.10",)], "t string")
    assert [r[0] for r in rows.select(J.canonical_json(F.col("t"))).collect()] == ['{"a":{"c":null,"d":[1000,{"x":2,"y":1}]},"b":1.5}', None, '"plain"', '"["', "0.1"]


def of(spark, *traces):
    return spark.createDataFrame([(f"t{i}", t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in enumerate(traces)], "trace_id string, raw string")


def events(spark, *items):
    ev, diag = generic.generic_events(of(spark, list(items)))
    return ev.orderBy("ord").collect(), sorted((r.pos, r.code, r.path) for r in diag.collect())


def test_identities_are_strings_or_numbers_of_the_first_defined_key(spark):
    call = {"type": "tool_call", "name": "n"}
    got, diag = events(
        spark, {**call, "id": "a", "call_id": 123456789.5, "parent_id": 0.10}, {**call, "event_id": True, "call_id": "  ", "tool_call_id": "real"}, {**call, "event_id": None, "eventId": 7, "call_id": " c "},
        {**call, "sequence": "12", "timestamp": 1700000000.5}, {**call, "seq": 1.5, "timestamp": False, "time": "x"}, {**call, "index": [], "ts": 1, "createdAt": "2024-01-01T00:00:00Z"},
    )
    assert [(r.event_id, r.call_id, r.parent_id) for r in got[:3]] == [("a", "123456789.5", "0.1"), ("generic:1", None, None), ("7", " c ", None)]
    assert [(r.sequence, r.ts_raw) for r in got[3:]] == [(12, "1700000000.5"), (4, None), (0, "2024-01-01T00:00:00Z")]
    assert diag == [(4, "INVALID_SEQUENCE", "$[4]"), (4, "INVALID_TIMESTAMP", "$[4]")]
    assert got[3].ts.timestamp() == 1700000000.5 and got[5].ts is not None and got[4].ts is None


def test_fields_of_every_kind(spark):
    got, diag = events(
        spark, {"type": "web.search-call", "args": {"q": 25000000.5}}, {"type": "tool_use", "input": '{"a": 1.0}', "id": "u"}, {"type": "function", "function": {"name": "f", "arguments": "[1, 2"}, "success": True},
        {"type": "tool_result", "tool_use_id": "u", "output": {"z": 1, "a": 1e3}, "is_error": True}, {"type": "file", "filename": "r.md", "path": "/r", "media_type": "text/markdown", "action": "write", "data": [1]},
        {"type": "exception", "error": {"message": "boom", "code": 5, "data": {"x": 1}}}, {"type": "error", "detail": "late", "code": "E1"}, {"type": "error", "error": "plain"}, {"type": "transition", "name": "phase", "old_value": 1, "new_value": "b"},
        {"type": "state_change", "state": {"key": "k", "previous": None, "current": {"n": 0.50}}, "status": "unknown"}, {"role": "Agent", "text": "hey", "state": "queued"}, {"role": "agent", "content": [{"text": "a"}, "b"]}, {"type": "input_text"},
    )
    assert [(r.kind, r.tool_name, r.call_id, r.payload, r.value, r.status) for r in got[:4]] == [
        ("tool_call", "web_search", None, '{"q":25000000.5}', '{"q":25000000.5}', "pending"), ("tool_call", "unknown_tool", "u", '{"a":1}', '{"a":1}', "pending"),
        ("tool_call", "f", None, "[1, 2", '"[1, 2"', "succeeded"), ("tool_result", None, "u", '{"z":1,"a":1000}', '{"z":1,"a":1000}', "failed")]
    assert (got[4].name, got[4].uri, got[4].mime_type, got[4].operation, got[4].value) == ("r.md", "/r", "text/markdown", "write", "[1]")
    assert [(r.payload, r.error_code, r.value, r.status) for r in got[5:8]] == [("boom", "5", '{"x":1}', "failed"), ("late", "E1", None, "failed"), ("plain", None, None, "failed")]
    assert [(r.value, r.status) for r in got[8:10]] == [('{"name":"phase","from":1,"to":"b"}', "unknown"), ('{"name":"k","to":{"n":0.5}}', "unknown")]
    assert [(r.role, r.payload, r.value, r.status) for r in got[10:]] == [("unknown", "hey", '"hey"', "pending"), ("assistant", "a b", '[{"text":"a"},"b"]', "succeeded"), ("unknown", "", '""', "succeeded")]
    assert diag == [(1, "MALFORMED_TOOL_CALL", "$[1]"), (2, "MALFORMED_TOOL_ARGUMENTS", "$[2]")]


def test_blocks_and_calls_keep_their_places(spark):
    message = {"role": "assistant", "sequence": -1, "content": [{"type": "tool-use", "id": "k1", "name": "go", "sequence": "x"}, {"type": "text", "text": "hi"}, "more"], "tool_calls": [{"id": "k2", "function": {"name": "run", "arguments": "{}"}}, 5]}
    only = {"role": "assistant", "content": [{"type": "tool_result", "tool_use_id": "k1", "content": "out"}], "tool_calls": [{"id": "never"}]}
    silent = {"role": "assistant", "content": "", "function_call": {"name": "solo", "call_id": "k3"}}
    got, diag = events(spark, message, only, silent, {"role": "tool", "tool_call_id": "k3", "content": "x", "timestamp": {}}, {"type": "odd"}, 7, "{\"type\":\"message\"}")
    assert [(r.kind, r.tool_name, r.call_id, r.payload, r.path, r.sequence) for r in got] == [
        ("message", None, None, "hi more", "$[0].content[text]", 0), ("tool_call", "run", "k2", "{}", "$[0].tool_calls[0]", 1), ("tool_call", "go", "k1", None, "$[0].content[0]", 2),
        ("tool_result", None, "k1", "out", "$[1].content[0]", 3), ("tool_call", "solo", "k3", None, "$[2].tool_calls[0]", 4), ("tool_result", None, "k3", "x", "$[3]", 5)]
    assert diag == sorted([(0, "INVALID_SEQUENCE", "$[0]")] * 2 + [(0, "INVALID_SEQUENCE", "$[0].content[0]"), (0, "MALFORMED_EVENT", "$[0].tool_calls[1]")] + [(3, "INVALID_TIMESTAMP", "$[3]")] * 2 + [(4, "UNSUPPORTED_EVENT", "$[4]"), (5, "MALFORMED_EVENT", "$[5]"), (6, "MALFORMED_EVENT", "$[6]")])


def test_roots(spark):
    ev, diag = generic.generic_events(of(spark, {"messages": [{"role": "user", "content": "a"}], "items": []}, {"role": "user", "content": "b"}, '"text"', "{oops", None, [], "5"))
    assert {(r.trace_id, r.path) for r in ev.collect()} == {("t0", "$.messages[0]"), ("t1", "$")}
    assert {(r.trace_id, r.code) for r in diag.collect()} == {("t2", "INVALID_TRACE_ROOT"), ("t3", "INVALID_JSON"), ("t6", "INVALID_TRACE_ROOT")}


def hashed(spark, *items, lossy=False):
    ev, _ = generic.generic_events(of(spark, list(items)))
    e = legacy.unique_event_ids(ev)
    pairs = pairing.pair_calls(e)
    facts = spark.createDataFrame([("t0", "generic_json", lossy)], "trace_id string, source_format string, lossy boolean")
    return generic.trace_hash(e, pairs, pairing.orphan_results(e, pairs), facts).first().hash


def test_hash_is_of_the_content(spark):
    a = [{"type": "tool_call", "id": "c", "call_id": "k", "name": "n", "arguments": {"b": {"y": 1, "x": 2.50}, "a": [1]}}, {"type": "tool_result", "id": "r", "call_id": "k", "output": "ok"}, {"type": "tool_result", "id": "o", "output": "lost"}]
    turned = [{"arguments": '{"a":[1.0],"b":{"x":2.5,"y":1}}', **{k: v for k, v in a[0].items() if k != "arguments"}}, *a[1:]]
    base = hashed(spark, *a)
    assert base.startswith("sha256:") and base == hashed(spark, *turned)
    others = [hashed(spark, *a, lossy=True), hashed(spark, *a[:2]), hashed(spark, a[0], {**a[1], "output": "ok "}, a[2]), hashed(spark, {**a[0], "timestamp": 5}, *a[1:]), hashed(spark, {**a[0], "timestamp": "5"}, *a[1:])]
    assert len({base, *others}) == 6


def test_all_that_is_said_of_a_trace(spark):
    ev, parsed = generic.generic_events(of(spark, [{"type": "tool_call", "id": "c", "call_id": "k", "name": "n"}, {"type": "tool_call", "id": "c", "call_id": "k", "name": "n", "sequence": -3}, {"type": "tool_result", "id": "x"}, {"type": "odd"}]))
    e = legacy.unique_event_ids(ev)
    pairs = pairing.pair_calls(e)
    secrets = spark.createDataFrame([("t0", 2), ("t0", 1), ("t9", 0)], "trace_id string, n long")
    got = generic.trace_diagnostics(parsed, e, pairing.pairing_diagnostics(e, pairs), secrets).collect()
    said = sorted((r.code, r.severity, r.category, r.path or "", tuple(r.event_ids or [])) for r in got)
    assert said == sorted([
        ("INVALID_SEQUENCE", "warning", "validation", "$[1]", ()), ("UNSUPPORTED_EVENT", "warning", "parsing", "$[3]", ()), ("DUPLICATE_EVENT_ID", "warning", "validation", "$[1]", ("c", "c#2")), ("DUPLICATE_CALL_ID", "warning", "pairing", "$[0]", ("c", "c#2")),
        ("UNMATCHED_TOOL_CALL", "warning", "pairing", "$[0]", ("c",)), ("UNMATCHED_TOOL_CALL", "warning", "pairing", "$[1]", ("c#2",)), ("MISSING_CALL_ID", "warning", "pairing", "$[2]", ("x",)), ("REDACTED_SECRET", "info", "redaction", "", ()),
    ])
    summary = generic.trace_summary(e, parsed, secrets).collect()
    assert [tuple(r) for r in summary if r.trace_id == "t0"] == [("t0", 3, 2, 0, True, True, 3)]


def test_traces_are_parsed_once_and_fields_looked_up_once(spark, monkeypatch):
    """Roots that aren't traces come with the records, not from a parse of their own; events are made of columns, not of map lookups."""
    opened = []
    monkeypatch.setattr(generic, "open_traces", lambda traces, f=generic.open_traces: opened.append(f(traces)) or opened[-1])
    events, diagnostics = generic.generic_events(spark.createDataFrame([("a", '[{"type":"message","id":"m"}]'), ("b", "{broken"), ("c", "3"), ("d", None)], "trace_id string, raw string"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert len(opened) == 1 and "MapInArrow" not in plan(events) and "MapInArrow" not in plan(diagnostics) and "map<" not in str(events.sparkSession.createDataFrame([], events.schema).dtypes)
    assert sorted((r.trace_id, r.code, r.pos, r.path, r.event_ids) for r in diagnostics.collect()) == [("b", "INVALID_JSON", None, "$", None), ("c", "INVALID_TRACE_ROOT", None, "$", None)]
    assert [(r.trace_id, r.event_id) for r in events.collect()] == [("a", "m")]


def test_fields_are_those_of_the_first_defined_key():
    record = {"content": "", "output": " x", "id": 7, "tool_use_id": "t", "type": " Tool Call ", "state": {"key": "k", "name": None}, "args": '{"b": 1.0}', "index": "3"}
    got = dict(generic._fields(record))
    assert got["result"] == ("s", " x", " x") and got["content"] == ("s", "", None) and got["call_own_id"] == ("s", "t", "t") and got["event_id"] == ("n", "7", "7")
    assert got["state_name"] == ("s", "k", "k") and got["arguments"] == ("o", '{"b":1}', None) and got["sequence"] == ("n", "3", "3") and got["type_word"][1] == "_tool_call_"
    assert all(n in got or not any(k in record for k in keys) for n, keys in generic.ALIASES.items() if "/" not in keys[0])
