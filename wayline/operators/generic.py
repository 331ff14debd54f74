"""JSON traces: generic event arrays and response envelopes, item by item as JSON text.

An item is parsed once: :func:`open_items` gives its fields by meaning, each the value of its
first defined key, with kind and text, and the same for its content blocks and nested calls.
Everything after that is expressions over these fields.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wayline.functions import json_values
from wayline.functions.lexicons import STATUS_SYNONYMS
from wayline.functions.text import blank
from wayline.plans.storage import materialize

#: Keys under which a field may stand, the first defined one counts; ``a/b`` is member b of object a.
ALIASES = {
    "event_id": ["event_id", "eventId", "id"],
    "sequence": ["sequence", "seq", "index"],
    "ts": ["timestamp", "time", "created_at", "createdAt"],
    "call_id": ["call_id", "callId", "tool_call_id", "toolCallId", "invocation_id"],
    "call_own_id": ["tool_use_id", "id"],
    "result_own_id": ["tool_use_id", "function_call_id"],
    "nested_id": ["call_id", "tool_call_id", "id"],
    "parent_id": ["parent_id", "parentId", "parent_event_id", "previous_response_id"],
    "type": ["type", "kind", "event", "event_type"],
    "role": ["role"],
    "provenance": ["provenance", "provenance_level"],
    "status": ["status", "state"],
    "is_error": ["is_error"],
    "error": ["error"],
    "success": ["success"],
    "ok": ["ok"],
    "tool_name": ["tool_name", "name"],
    "function_name": ["function/name"],
    "arguments": ["arguments", "args", "input", "parameters", "action"],
    "function_arguments": ["function/arguments", "function/args", "function/input"],
    "result": ["result", "output", "content", "value", "data"],
    "content": ["content", "text", "message", "value"],
    "tool_calls": ["tool_calls", "toolCalls"],
    "function_call": ["function_call"],
    "name": ["name", "filename", "id"],
    "uri": ["uri", "url", "path"],
    "mime_type": ["mime_type", "mimeType", "media_type"],
    "operation": ["operation", "action"],
    "data": ["data", "content", "value"],
    "error_message": ["error/message"],
    "message": ["message", "detail"],
    "error_code": ["error/code", "error/type"],
    "code": ["code"],
    "error_details": ["error/details", "error/data"],
    "details": ["details", "data"],
    "state": ["state"],
    "state_name": ["state/name", "state/key"],
    "state_from": ["state/from", "state/previous", "state/old_value"],
    "state_to": ["state/to", "state/next", "state/new_value", "state/current"],
    "state_value": ["state/value"],
    "own_name": ["name", "key"],
    "own_from": ["from", "previous", "old_value"],
    "own_to": ["to", "next", "new_value", "current"],
    "own_value": ["value"],
}
#: Fields whose strings are parsed where they look like JSON.
JSON_TEXTS = {"arguments", "function_arguments", "result"}
#: Types of each kind; results are tested before calls.
RESULT_TYPES = ["tool_result", "tool_output", "function_result", "function_call_output"]
CALL_TYPES = ["tool_call", "tool_use", "function_call", "function"]
BLOCK_TYPES = ["tool_use", "tool_call", "tool_result"]
KINDS = {"artifact": ["artifact", "file", "attachment"], "error": ["error", "exception"], "state_change": ["state_change", "state_changed", "transition"]}
MESSAGE_TYPES = ["message", "input_text", "output_text"]

#: Severity and category of every code.
CODES = {
    "INVALID_JSON": ("error", "parsing"), "INVALID_TRACE_ROOT": ("error", "parsing"), "MALFORMED_EVENT": ("error", "parsing"), "MALFORMED_TOOL_CALL": ("error", "parsing"),
    "UNSUPPORTED_EVENT": ("warning", "parsing"), "MALFORMED_TOOL_ARGUMENTS": ("warning", "parsing"), "MALFORMED_TOOL_RESULT": ("warning", "parsing"),
    "INCOMPLETE_STREAM_DELTA": ("warning", "parsing"), "INFERRED_CALL_LINK": ("warning", "parsing"), "EMPTY_TRACE": ("warning", "parsing"),
    "INVALID_SEQUENCE": ("warning", "validation"), "INVALID_TIMESTAMP": ("warning", "validation"), "DUPLICATE_EVENT_ID": ("warning", "validation"),
    "MISSING_CALL_ID": ("warning", "pairing"), "DUPLICATE_CALL_ID": ("warning", "pairing"), "ORPHAN_TOOL_RESULT": ("warning", "pairing"), "UNMATCHED_TOOL_CALL": ("warning", "pairing"),
    "REDACTED_SECRET": ("info", "redaction"),
}
DIAGNOSTIC = "trace_id string, code string, pos bigint, path string, event_ids array<string>"

#: How values are read where it is not as they are.
TAGS = {n: json_values.tagged_field for n in JSON_TEXTS} | {"sequence": json_values.tagged_count}
_VALUE = pa.struct([("t", pa.string()), ("v", pa.string()), ("x", pa.string())])
_FIELDS = pa.map_(pa.string(), _VALUE)  # of the fields that a record has
_PART = pa.struct([("object", pa.bool_()), ("f", _FIELDS), ("json", pa.string()), ("text", pa.string())])
_VALUE_SQL = "struct<t:string,v:string,x:string>"
_FIELDS_SQL = f"map<string,{_VALUE_SQL}>"
_PART_SQL = f"struct<object:boolean,f:{_FIELDS_SQL},json:string,text:string>"


_GAPS = re.compile(r"[.\s\-]+")
#: Fields that events are made of.
_FIELD_NAMES = [n for n in [*ALIASES, "type_word"] if n not in ("tool_calls", "function_call")]
#: By the object that holds it ("" for the record) and its key: the fields that a value may fill, with its rank among their keys and how it is read.
_FILLS: dict[str, dict[str, list[tuple]]] = {}
for _name, _keys in ALIASES.items():
    for _rank, _key in enumerate(_keys):
        _FILLS.setdefault(_key.rpartition("/")[0], {}).setdefault(_key.rpartition("/")[2], []).append((_name, _rank, TAGS.get(_name, json_values.tagged)))


def _fields(record: dict) -> list[tuple]:
    """Kind t, text v and own text x of the first defined key of every field that the record has, by name; x is the text of a string with something in it or of a number."""
    best: dict[str, tuple] = {}
    for holder, fills in _FILLS.items():
        at = record.get(holder) if holder else record
        if type(at) is not dict:
            continue
        for key, value in at.items():
            if value is not None and key in fills:
                read = {}
                for name, rank, tag in fills[key]:
                    if name not in best or rank < best[name][0]:
                        if tag not in read:
                            if type(value) is str and tag is not json_values.tagged_count and value.isascii() and value[:1] > " " and value[0] not in "{[":
                                read[tag] = ("s", value, value)  # what reading would give
                            else:
                                kind, text = tag(value)
                                read[tag] = (kind, text, text if kind == "n" or (kind == "s" and text.strip(json_values.SPACES)) else None)
                        best[name] = (rank, read[tag])
    out = [(name, value) for name, (_, value) in best.items()]
    word = _GAPS.sub("_", (best["type"][1][2] or "").lower()) if "type" in best else ""
    return [*out, ("type_word", ("s", word, word or None))]


def _maps(records: list) -> pa.Array:
    """Fields of records (None for none) as maps, column by column."""
    flat = [x for r in records for x in r or ()]
    ends = np.cumsum([0, *(len(r or ()) for r in records)])
    offsets = pa.array(ends, pa.int32(), mask=np.array([*(r is None for r in records), False]))
    parts = pa.StructArray.from_arrays([pa.array([x[1][k] for x in flat], pa.string()) for k in range(3)], fields=list(_VALUE))
    return pa.MapArray.from_arrays(offsets, pa.array([x[0] for x in flat], pa.string()), parts)


def _part_lists(parts: list) -> pa.Array:
    """Lists of parts (None for none), column by column."""
    flat = [x for r in parts for x in r or ()]
    ends = np.cumsum([0, *(len(r or ()) for r in parts)])
    offsets = pa.array(ends, pa.int32(), mask=np.array([*(r is None for r in parts), False]))
    own = [pa.array([x["object"] for x in flat], pa.bool_()), _maps([x["f"] for x in flat]), *(pa.array([x[k] for x in flat], pa.string()) for k in ("json", "text"))]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(own, fields=list(_PART)))


def _opened_columns(rows: list[dict]) -> list[pa.Array]:
    made = {"f": _maps, "blocks": _part_lists, "calls": _part_lists}
    return [made[n]([r[n] for r in rows]) if n in made else pa.array([r[n] for r in rows], kind) for n, kind in _OPENED]


def _part(value) -> dict:
    whole = isinstance(value, dict)
    return {"object": whole, "f": _fields(value) if whole else None, "json": json_values.write(value), "text": json_values.plain_text(value)}


def _opened(record) -> dict:
    if not isinstance(record, dict):
        return _NOTHING
    calls = next((record[k] for k in ALIASES["tool_calls"] if record.get(k) is not None), None)
    if not isinstance(calls, list):
        calls = [record["function_call"]] if isinstance(record.get("function_call"), dict) else None
    blocks = record.get("content")
    said = next((x for k in ALIASES["content"] if (x := record.get(k)) is not None), "")
    return {"object": True, "f": _fields(record), "blocks": [_part(b) for b in blocks] if isinstance(blocks, list) else None, "calls": calls and [_part(c) for c in calls], "said": json_values.plain_text(said)}


def _parsed(text: str | None):
    try:
        return json_values.parse(text or "")
    except (ValueError, RecursionError):
        return None


_NOTHING = {"object": False, "f": None, "blocks": None, "calls": None, "said": None}
_OPENED = [("object", pa.bool_()), ("f", _FIELDS), ("blocks", pa.list_(_PART)), ("calls", pa.list_(_PART)), ("said", pa.string())]
_OPENED_SQL = f"object boolean, f {_FIELDS_SQL}, blocks array<{_PART_SQL}>, calls array<{_PART_SQL}>, said string"
#: Items of a long trace that are handed on at a time.
_RUN = 1000


def _root_items(text: str) -> tuple[str | None, str, list]:
    """(code, path prefix, items) of a trace: the root array, else the first of its arrays, else the object itself."""
    try:
        root = json_values.parse(text)
    except (ValueError, RecursionError):
        return "INVALID_JSON", "", []
    if isinstance(root, list):
        return None, "$", root
    if not isinstance(root, dict):
        return "INVALID_TRACE_ROOT", "", []
    for k in ("events", "messages", "trace", "items"):
        if isinstance(root.get(k), list):
            return None, f"$.{k}", root[k]
    return None, "", [root]


def open_traces(traces: DataFrame) -> DataFrame:
    """(trace_id, pos, path, code) and the columns of :func:`open_items`, a row per item of the traces (trace_id, raw).

    A trace that doesn't parse, or isn't an object or array, has one row with a code and no pos; a null trace has none.
    """

    def run(batches):
        for b in batches:
            for trace_id, text in ((i.as_py(), t.as_py()) for i, t in zip(b.column(0), b.column(1))):  # one text at a time
                if text is None:
                    continue
                code, base, items = _root_items(text)
                for at in range(0, len(items), _RUN) if items else [0] if code else []:
                    rows = [_opened(x) for x in items[at : at + _RUN]] or [_NOTHING]
                    pos = list(range(at, at + len(rows))) if items else [None]
                    paths = [f"{base}[{p}]" if base else "$" for p in pos]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([trace_id] * len(rows), pa.string()), pa.array(pos, pa.int32()), pa.array(paths), pa.array([code] * len(rows), pa.string()), *_opened_columns(rows)],
                        names=["trace_id", "pos", "path", "code", *(n for n, _ in _OPENED)],
                    )

    return traces.select(F.col("trace_id").cast("string"), F.col("raw").cast("string")).mapInArrow(run, f"trace_id string, pos int, path string, code string, {_OPENED_SQL}")


def open_items(items: DataFrame) -> DataFrame:
    """``items`` with their JSON text ``item`` replaced by what it holds.

    object tells whether it is an object; f has the fields by :data:`ALIASES` as (t, v, x), kind,
    text, and text that may name something; blocks the parts of its content if that is an array, calls its nested calls, each
    with fields, JSON and text; said is the content's text.
    """
    keys = [c for c in items.columns if c != "item"]

    def run(batches):
        for b in batches:
            rows = [_opened(_parsed(t)) for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *_opened_columns(rows)], names=[*keys, *(n for n, _ in _OPENED)])

    kept = items.select(*keys, "item")
    return kept.mapInArrow(run, ", ".join([f"`{n}` {t}" for n, t in kept.dtypes if n != "item"] + [_OPENED_SQL]))


def _text(f: Column, name: str) -> Column:
    """A field that is a string with something in it or a number, as text."""
    return f[name]["x"]


def _json(x: Column) -> Column:
    """The JSON text of a tagged value."""
    return F.when(x["t"].isin("s", "x"), quoted(x["v"])).otherwise(x["v"])


def quoted(text: Column) -> Column:
    """A text as a JSON string; null for null."""
    return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", ""))


def type_of(f: Column) -> Column:
    """The type in lower case, its words joined by underscores; empty without one."""
    return F.coalesce(f["type_word"]["v"], F.lit(""))


def kind_of(f: Column) -> Column:
    """The kind of event that a record is; null for none."""
    t, role = type_of(f), f["role"]
    result = t.isin(*RESULT_TYPES) | t.endswith("_call_output")
    out = F.when(result, "tool_result").when(t.isin(*CALL_TYPES) | t.endswith("_call"), "tool_call")
    for kind, types in KINDS.items():
        out = out.when(t.isin(*types), kind)
    is_text = F.coalesce(role["t"] == "s", F.lit(False))
    return out.when(is_text & (role["v"] == "tool"), "tool_result").when(t.isin(*MESSAGE_TYPES) | is_text, "message")


def _record(f: Column, path: Column, text: Column, forced: str | None = None, content: Column | None = None) -> Column:
    """A record that may become an event: its fields, where it stands, its text, a type that it takes, and a content in place of its own."""
    return F.struct(f.alias("f"), path.alias("path"), text.alias("text"), F.lit(forced).alias("forced"), (F.lit(None).cast("string") if content is None else content).alias("content"))


def _codes(*codes: Column) -> Column:
    return F.array_compact(F.array(*codes))


def _code(when: Column, name: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(name))


def _identity_codes(f: Column) -> Column:
    return _codes(_code(f["sequence"]["t"] == "x", "INVALID_SEQUENCE"), _code(~f["ts"]["t"].isin("s", "n"), "INVALID_TIMESTAMP"))


def _records(opened: DataFrame, odd_item: str) -> DataFrame:
    """(trace_id, pos, sub, entry, codes, kind, f, path, text, forced, content), a row per record, and for items without one a row with no f.

    A message's nested calls follow it, then its structured blocks; codes tells what is
    odd about the identities of the whole item, on its first row.
    """
    f, path = F.col("f"), F.col("path")
    none = F.array().cast(f"array<{_PART_SQL}>")
    structured = lambda x: F.coalesce(x["b"]["object"] & type_of(x["b"]["f"]).isin(*BLOCK_TYPES), F.lit(False))
    numbered = F.transform(F.coalesce("blocks", none), lambda b, i: F.struct(i.alias("i"), b.alias("b")))
    entry = F.col("entry") if "entry" in opened.columns else F.lit(None).cast("long")
    code = F.col("code") if "code" in opened.columns else F.lit(None).cast("string")
    rows = opened.select("trace_id", "pos", "path", code.alias("code"), "object", "f", "said", entry.alias("entry"), kind_of(f).alias("kind"), numbered.alias("blocks"), F.coalesce("calls", none).alias("calls"))
    is_message = F.coalesce(F.col("kind") == "message", F.lit(False))
    rows = rows.withColumn("inner", F.filter("blocks", lambda x: is_message & structured(x))).withColumn("rest", F.transform(F.filter("blocks", lambda x: ~structured(x)), lambda x: x["b"]))
    split = F.size("inner") > 0
    has_calls = F.coalesce(f["tool_calls"]["t"] == "a", F.lit(False)) | F.coalesce(f["function_call"]["t"] == "o", F.lit(False))
    silent = F.coalesce((f["content"]["t"] == "s") & (f["content"]["v"] == ""), f["content"].isNull())
    stays = F.when(split, F.size("rest") > 0).otherwise(~(is_message & silent & has_calls))
    left = F.concat(F.lit("["), F.array_join(F.transform("rest", lambda b: b["json"]), ","), F.lit("]"))
    text = F.when(split, F.array_join(F.filter(F.transform("rest", lambda b: b["text"]), lambda t: t != ""), " ")).otherwise(F.col("said"))
    own = F.when(stays, _record(f, F.when(split, F.concat(path, F.lit(".content[text]"))).otherwise(path), text, content=F.when(split, left)))
    under = lambda name, i: F.concat(path, F.lit(f".{name}["), i, F.lit("]"))
    nested = F.transform(F.when(is_message & ~(split & (F.size("rest") == 0)), F.col("calls")).otherwise(none), lambda c, i: _record(c["f"], under("tool_calls", i), c["text"], "tool_call"))
    blocks = F.transform("inner", lambda x: _record(x["b"]["f"], under("content", x["i"]), x["b"]["text"], "block"))
    # A message parted from its blocks, and one of a tool, are looked at a second time.
    times = F.when(split, F.least(F.lit(1), F.size("rest")) + 1).when((F.col("kind") == "tool_result") & ~_is_result(f), 2).otherwise(1)
    codes = F.when(F.col("code").isNotNull(), F.array("code")).when(F.col("object"), F.flatten(F.array_repeat(_identity_codes(f), times))).otherwise(F.array(F.lit(odd_item)))
    every = F.when(F.col("object"), F.concat(F.array_compact(F.array(own)), nested, blocks))
    each = rows.select("trace_id", "pos", "entry", codes.alias("codes"), path.alias("item_path"), F.posexplode_outer(every).alias("sub", "r"))
    first = F.coalesce("sub", F.lit(0)) == 0
    parts = each.select("trace_id", "pos", F.coalesce("sub", F.lit(0)).alias("sub"), "entry", F.when(first, F.col("codes")).alias("codes"), "item_path", F.col("r").isNotNull().alias("some"), "r.*")
    return parts.withColumn("kind", F.when(F.col("forced") == "tool_call", F.when(F.col("f").isNotNull(), "tool_call")).otherwise(kind_of(F.col("f"))))


def events_of_opened(opened: DataFrame, prefix: str, odd_item: str = "MALFORMED_EVENT") -> tuple[DataFrame, DataFrame]:
    """(events, diagnostics) of opened items (trace_id, pos, path, entry where items without a sequence take that number, and code where a trace has no items).

    Events are numbered (ord) in order of their records.  Identities are the first defined
    key's, if that is a string with something in it or a number; a sequence is a whole
    number from 0, or else the running number with INVALID_SEQUENCE; a time is a string or a
    number, or else nothing with INVALID_TIMESTAMP; arguments and results that look like JSON
    are parsed, or stay text with MALFORMED_TOOL_ARGUMENTS or MALFORMED_TOOL_RESULT.  Records
    of unknown type are dropped with UNSUPPORTED_EVENT, items that aren't objects with
    ``odd_item``, nested calls that aren't with MALFORMED_EVENT; a call without a name is an ``unknown_tool`` with
    MALFORMED_TOOL_CALL.  payload is the text of what an event holds, value the same as JSON.
    """
    order = Window.partitionBy("trace_id").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, -1)
    records = _records(opened, odd_item)
    records = records.withColumn("ord", F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), 1).otherwise(0)).over(order), F.lit(0)))
    # Written with a column per field: what follows names most of them several times, and over so many columns Spark compiles it in small parts.
    records = materialize(records.select(*[c for c in records.columns if c != "f"], F.col("f").isNotNull().alias("known"), *[F.col("f")[n].alias(f"f_{n}") for n in _FIELD_NAMES]), "records")
    f, known, forced, first = {n: F.col(f"f_{n}") for n in _FIELD_NAMES}, F.col("known"), F.col("forced"), F.coalesce
    is_ = lambda k: F.col("kind") == k
    type_ = type_of(f)
    derived = F.when(forced == "tool_call", "tool").when(type_.endswith("_call"), F.nullif(F.regexp_replace(type_, "_call$", ""), F.lit("")))
    tool = first(_text(f, "tool_name"), F.when(is_("tool_call"), first(_text(f, "function_name"), derived)))
    args, result = first(f["arguments"], f["function_arguments"]), f["result"]
    call = first(F.when(forced == "tool_call", _text(f, "nested_id")), _text(f, "call_id"), F.when(is_("tool_call"), _text(f, "call_own_id")).when(is_("tool_result"), _text(f, "result_own_id")))
    event_id = first(_text(f, "event_id"), F.concat(F.lit(f"{prefix}:"), "ord"))
    said = first(F.when(f["error"]["t"] == "s", f["error"]["v"]), _text(f, "error_message"), _text(f, "message"), F.lit("Unknown trace error"))
    in_object = F.coalesce(f["state"]["t"] == "o", F.lit(False))
    member = lambda key, kind: F.when(in_object, kind(f"state_{key}")).otherwise(kind(f"own_{key}"))
    state = F.concat_ws(",", F.concat(F.lit('"name":'), member("name", lambda n: quoted(_text(f, n)))), *[F.concat(F.lit(f'"{k}":'), member(k, lambda n: _json(f[n]))) for k in ("from", "to", "value")])
    state = F.concat(F.lit("{"), state, F.lit("}"))
    value = F.when(is_("message"), first("content", _json(f["content"]), F.lit('""'))).when(is_("tool_call"), first(_json(args), F.lit("null"))).when(is_("tool_result"), first(_json(result), F.lit("null")))
    value = value.when(is_("artifact"), _json(f["data"])).when(is_("error"), _json(first(f["error_details"], f["details"]))).otherwise(state)
    payload = F.when(is_("message"), F.col("text")).when(is_("tool_call"), args["v"]).when(is_("tool_result"), result["v"]).when(is_("artifact"), f["data"]["v"]).when(is_("error"), said).otherwise(state)
    artifact = [F.when(is_("artifact"), _text(f, n)).alias(n) for n in ("name", "uri", "mime_type", "operation")]
    own_number = F.when((F.col("sub") == 0) & forced.isNull(), F.col("entry"))
    events = records.where("kind is not null").select(
        *["trace_id", F.col("ord").cast("long").alias("ord"), event_id.alias("event_id")],
        first(F.when(f["sequence"]["t"] == "n", f["sequence"]["v"].cast("long")), F.when(f["sequence"].isNull(), own_number), F.col("ord").cast("long")).alias("sequence"),
        "kind",
        F.when(f["ts"]["t"].isin("s", "n"), f["ts"]["v"]).alias("ts_raw"),
        F.when(f["ts"]["t"].isin("s", "n"), f["ts"]["t"] == "n").alias("ts_number"),
        _timestamp(f["ts"]).alias("ts"),
        *[call.alias("call_id"), _text(f, "parent_id").alias("parent_id"), _status(f).alias("status"), _provenance(f).alias("provenance"), F.when(is_("message"), _role(f)).alias("role")],
        F.when(is_("tool_call"), first(tool, F.lit("unknown_tool"))).when(is_("tool_result"), tool).alias("tool_name"),
        *[payload.alias("payload"), value.alias("value"), *artifact, F.when(is_("error"), first(_text(f, "error_code"), _text(f, "code"))).alias("error_code")],
        *["pos", "path", F.when(type_ != "", type_).when(f["role"]["t"] == "s", "message").otherwise("unknown").alias("raw_type")],
    )
    part = F.coalesce(forced.isNotNull(), F.lit(False))
    own_codes = F.concat(
        F.when(part & known, _identity_codes(f)).otherwise(F.array().cast("array<string>")),
        _codes(
            _code(F.col("some") & ~known, "MALFORMED_EVENT"), _code(known & F.col("kind").isNull(), "UNSUPPORTED_EVENT"), _code(is_("tool_call") & tool.isNull(), "MALFORMED_TOOL_CALL"),
            _code(is_("tool_call") & (args["t"] == "x"), "MALFORMED_TOOL_ARGUMENTS"), _code(is_("tool_result") & (result["t"] == "x"), "MALFORMED_TOOL_RESULT"),
        ),
    )
    at = lambda codes, path: F.transform(codes, lambda c: F.struct(c.alias("code"), path.alias("path")))
    found = records.select("trace_id", "pos", event_id.alias("event_id"), F.explode(F.concat(at(first("codes", F.array().cast("array<string>")), F.col("item_path")), at(own_codes, first("path", "item_path")))).alias("c"))
    ids = F.when(F.col("c.code") == "MALFORMED_TOOL_CALL", F.array("event_id"))
    return events, found.select("trace_id", F.col("c.code").alias("code"), F.col("pos").cast("long").alias("pos"), F.col("c.path").alias("path"), ids.alias("event_ids"))


def _is_result(f: Column) -> Column:
    t = type_of(f)
    return t.isin(*RESULT_TYPES) | t.endswith("_call_output")


def _timestamp(x: Column) -> Column:
    """A time as timestamp where it is one: text as Spark reads it, a number as seconds, or milliseconds from 1e11 on."""
    n = F.when(x["t"] == "n", x["v"].try_cast("double"))
    seconds = F.when(F.abs(n) >= 1e14, None).when(F.abs(n) >= 1e11, n / 1000).otherwise(n)
    return F.when(x["t"] == "s", F.try_to_timestamp(x["v"])).otherwise(F.timestamp_micros((seconds * 1_000_000).cast("long")))


def _status(f: Column) -> Column:
    """The status from flags first, then from synonyms, else what the kind suggests; an error has failed."""
    true = lambda n: F.coalesce((f[n]["t"] == "b") & (f[n]["v"] == "true"), F.lit(False))
    lost = true("is_error") | true("error") | F.coalesce((f["success"]["t"] == "b") & (f["success"]["v"] == "false"), F.lit(False))
    known = F.create_map(*[F.lit(x) for k, v in STATUS_SYNONYMS.items() if k != "unknown" for x in (k, v)])
    kind = F.col("kind")
    fallback = F.when(kind == "tool_call", "pending").when(kind == "message", "succeeded").otherwise("unknown")
    return F.when(kind == "error", "failed").when(lost, "failed").when(true("success") | true("ok"), "succeeded").otherwise(F.coalesce(F.try_element_at(known, F.lower(_text(f, "status"))), fallback))


def _provenance(f: Column) -> Column:
    p = _text(f, "provenance")
    return F.when(p.isin("declared", "recorded", "verified"), p).otherwise("recorded")


def _role(f: Column) -> Column:
    role = F.when(f["role"]["t"] == "s", f["role"]["v"])
    return F.when(role == "agent", "assistant").when(role.isin("user", "assistant", "system", "tool"), role).otherwise("unknown")


def generic_events(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, diagnostics) of JSON traces (trace_id, raw); see :func:`events_of_opened`.

    Text that doesn't parse gives INVALID_JSON, JSON that is neither object nor array
    INVALID_TRACE_ROOT; a null text gives nothing.
    """
    return events_of_opened(open_traces(traces), "generic")


def graded(diagnostics: DataFrame) -> DataFrame:
    """``diagnostics`` with severity and category of their codes."""
    of = lambda k: F.create_map(*[F.lit(x) for code, grades in CODES.items() for x in (code, grades[k])])
    return diagnostics.withColumns({"severity": F.try_element_at(of(0), F.col("code")), "category": F.try_element_at(of(1), F.col("code"))})


# -- response envelopes and streams


def _stamped(item: Column, stamp: Column) -> Column:
    """An object with a timestamp: its own, or else the given one (number or text)."""
    quoted = F.when(stamp.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), stamp).otherwise(F.regexp_replace(F.to_json(F.array(stamp)), r"^\[|\]$", ""))
    own = F.coalesce(F.get_json_object(item, "$.timestamp"), F.get_json_object(item, "$.created_at"))
    rest = F.substr(F.ltrim(item), F.lit(2))
    put = F.concat(F.lit('{"timestamp":'), quoted, F.when(F.trim(rest) == "}", "").otherwise(","), rest)
    return F.when(own.isNull() & stamp.isNotNull() & F.startswith(F.ltrim(item), F.lit("{")), put).otherwise(item)


def _plain(item: Column, name: str) -> Column:
    """A field that is neither object nor array nor blank, as text."""
    x = F.get_json_object(item, f"$.{name}")
    return F.when(~F.trim(x).rlike(r"^[\[{]") & ~blank(x), x)


def _output_items(responses: DataFrame) -> DataFrame:
    """(trace_id, pos, path, item) of response objects (trace_id, at, response); items without a time take the response's."""
    stamp = F.coalesce(_plain(F.col("response"), "created_at"), _plain(F.col("response"), "timestamp"))
    each = responses.select("trace_id", "at", stamp.alias("stamp"), F.posexplode(F.from_json(F.get_json_object("response", "$.output"), "array<string>")).alias("pos", "item"))
    return each.select("trace_id", "pos", F.concat("at", F.lit(".output["), "pos", F.lit("]")).alias("path"), _stamped(F.col("item"), F.col("stamp")).alias("item"))


def _got(path: str) -> Column:
    return F.get_json_object("item", f"$.{path}")


def typed_messages(messages: DataFrame) -> DataFrame:
    """``messages`` (item) with type, the body of items that are added or finished, and the id of the item that they speak of."""
    typed = messages.withColumn("type", F.coalesce(_plain(F.col("item"), "type"), _plain(F.col("item"), "event"), _plain(F.col("item"), "kind"), F.lit("")))
    is_item = F.col("type").isin("response.output_item.added", "response.output_item.done")
    bodied = typed.withColumn("body", F.when(is_item & F.startswith(_got("item"), F.lit("{")), _got("item")))
    return bodied.withColumn("id", F.when(is_item, F.get_json_object("body", "$.id")).otherwise(_got("item_id")))


def fold_response_stream(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, diagnostics) of response stream messages (trace_id, pos, item); both name the message by pos and path.

    The last completed response with a body replaces everything.  Else a finished item stands
    for its added item, its finished arguments or text and all its deltas; see :func:`response_entries`.
    """
    typed = typed_messages(messages)
    whole = typed.where((F.col("type") == "response.completed")).groupBy("trace_id").agg(F.max_by(_got("response"), "pos").alias("response")).where("response LIKE '{%'")
    rest = typed.join(whole.select("trace_id"), "trace_id", "left_anti")
    done = rest.where((F.col("type") == "response.output_item.done") & F.col("id").isNotNull()).select("trace_id", "id").distinct().withColumn("done", F.lit(True))
    items, left = response_entries(rest.join(done, ["trace_id", "id"], "left").withColumn("done", F.coalesce("done", F.lit(False))))
    return _output_items(whole.withColumn("at", F.lit("$[response.completed].response"))).unionByName(items), left


def response_entries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, diagnostics) of :func:`typed_messages` with done, which tells whether their item is finished.

    Finished arguments and texts of other items become calls and messages, states of the
    response state changes, failures errors.  Deltas of unfinished items are left over
    (INCOMPLETE_STREAM_DELTA); added or finished items without a body are MALFORMED_EVENT.
    """
    get, is_item = _got, F.col("type").isin("response.output_item.added", "response.output_item.done")
    t, stamp, id_ = F.col("type"), F.coalesce(get("timestamp"), get("created_at")), F.col("id")
    made = lambda **fields: F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in fields.items()], stamp.alias("timestamp")))
    call = made(type="function_call", event_id=F.coalesce(get("id"), id_), call_id=F.coalesce(get("call_id"), id_), name=F.coalesce(get("name"), F.lit("unknown_tool")), arguments=get("arguments"))
    text = made(type="message", event_id=F.coalesce(get("id"), F.concat(F.coalesce(id_, F.concat(F.lit("item-"), "pos")), F.lit(":text"))), parent_id=id_, role="assistant", content=F.coalesce(get("text"), F.lit("")), status="completed")
    failed = made(type="error", event_id=get("id"), error=F.coalesce(get("response.error"), get("error"), get("message"), F.lit("OpenAI response failed")))
    state = made(type="state_change", event_id=get("id"), parent_id=get("response.id"), state=F.struct(F.lit("response_status").alias("name"), F.coalesce(get("response.status"), F.regexp_replace(t, r"^response\.", "")).alias("to")), status=get("response.status"))
    entry = (
        F.when(is_item, F.when(~((t == "response.output_item.added") & F.col("done")), _stamped(F.col("body"), stamp)))
        .when(t == "response.function_call_arguments.done", F.when(~F.col("done"), call))
        .when(t == "response.output_text.done", F.when(~F.col("done"), text))
        .when(t.isin("response.failed", "error"), failed)
        .when(t.isin("response.created", "response.in_progress", "response.incomplete"), state)
        .when(~t.endswith(".delta"), F.col("item"))
    )
    code = F.when(t.endswith(".delta") & ~F.col("done"), "INCOMPLETE_STREAM_DELTA").when(is_item & F.col("body").isNull(), "MALFORMED_EVENT")
    path = F.concat(F.lit("$["), "pos", F.lit("]"))
    items = rows.select("trace_id", "pos", F.when(is_item, F.concat(path, F.lit(".item"))).otherwise(path).alias("path"), entry.alias("item")).where("item is not null")
    left = rows.select("trace_id", code.alias("code"), F.col("pos").cast("long").alias("pos"), path.alias("path"), F.lit(None).cast("array<string>").alias("event_ids")).where("code is not null")
    return items, left


def response_events(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, diagnostics) of response traces (trace_id, raw): a response object, an object that holds one, or stream messages.

    Anything else gives INVALID_TRACE_ROOT, and text that doesn't parse INVALID_JSON.
    """
    get = lambda path: F.get_json_object("raw", f"$.{path}")
    t = F.coalesce(_plain(F.col("raw"), "type"), _plain(F.col("raw"), "event"), _plain(F.col("raw"), "kind"))
    form = (
        F.when(F.startswith(F.ltrim("raw"), F.lit("[")), "array").when(~F.startswith(F.ltrim("raw"), F.lit("{")), "none").when(t.startswith("response."), "message").when(get("response").startswith("{"), "within")
        .when(get("output").startswith("["), "response").when(get("events").startswith("["), "events").when(t.isNotNull() | _plain(F.col("raw"), "role").isNotNull(), "item").otherwise("none")
    )
    rows = traces.where(F.try_parse_json("raw").isNotNull()).select("trace_id", "raw", form.alias("form"))
    messages = F.when(F.col("form") == "array", F.from_json("raw", "array<string>")).when(F.col("form") == "message", F.array("raw")).when(F.col("form") == "events", F.from_json(get("events"), "array<string>"))
    stream, left = fold_response_stream(rows.where("form in ('array', 'message', 'events')").select("trace_id", F.posexplode(messages).alias("pos", "item")))
    within = F.col("form") == "within"
    outputs = _output_items(rows.where("form in ('within', 'response')").select("trace_id", F.when(within, "$.response").otherwise("$response").alias("at"), F.when(within, get("response")).otherwise(F.col("raw")).alias("response")))
    single = rows.where("form = 'item'").select("trace_id", F.lit(0).alias("pos"), F.lit("$").alias("path"), F.col("raw").alias("item"))
    items = stream.unionByName(outputs).unionByName(single)
    items = items.withColumn("entry", F.row_number().over(Window.partitionBy("trace_id").orderBy("pos")).cast("long") - 1)
    events, diagnostics = events_of_opened(open_items(items), "openai", "UNSUPPORTED_EVENT")
    odd = lambda df, code: df.select("trace_id", F.lit(code).alias("code"), F.lit(None).cast("long").alias("pos"), F.lit("$").alias("path"), F.lit(None).cast("array<string>").alias("event_ids"))
    broken = traces.where(F.try_parse_json("raw").isNull() & F.col("raw").isNotNull())
    return events, diagnostics.unionByName(left).unionByName(odd(rows.where("form = 'none'"), "INVALID_TRACE_ROOT")).unionByName(odd(broken, "INVALID_JSON"))


# -- whole traces


def check_trace_constraints(events: DataFrame, pairs: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """(trace_id, rule, event_id): repeated event ids, and pairs and orphans that refer to events of another kind or none."""
    repeated = events.groupBy("trace_id", "event_id").agg(F.count("*").alias("n")).where("n > 1").select("trace_id", F.lit("event_id_repeated").alias("rule"), "event_id")
    refs = pairs.select("trace_id", F.explode(F.array(F.struct(F.lit("call_event_id_kind").alias("rule"), F.lit("tool_call").alias("kind"), F.col("call_event_id").alias("event_id")), F.struct(F.lit("result_event_id_kind").alias("rule"), F.lit("tool_result").alias("kind"), F.col("result_event_id").alias("event_id")))).alias("x")).select("trace_id", "x.*")
    if orphans is not None:
        refs = refs.unionByName(orphans.select("trace_id", F.lit("orphan_event_id_kind").alias("rule"), F.lit("tool_result").alias("kind"), "event_id"))
    wrong = refs.where("event_id is not null").join(events.select("trace_id", "event_id", "kind"), ["trace_id", "event_id", "kind"], "left_anti")
    return repeated.unionByName(wrong.select("trace_id", "rule", "event_id"))


#: Versions of the event schema and of the adapters; both are part of a trace's hash.
SCHEMA_VERSION, ADAPTER_VERSION = "1.0.0", "1.0.0"


def event_json(events: DataFrame, source_format: Column) -> Column:
    """The key-sorted JSON text of an event, without the fields that it lacks; see :func:`trace_hash` for the columns."""
    has = set(events.columns)
    column = lambda name: F.col(name) if name in has else F.lit(None).cast("string")
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    number = F.coalesce(column("ts_number").cast("boolean"), F.lit(False))
    source = F.struct(source_format.alias("format"), *([F.col("line")] if "line" in has else [F.col("ord").alias("index")]), column("path").alias("path"), column("raw_type").alias("raw_type"))
    plain = F.to_json(
        F.struct(
            *["event_id", "sequence", "call_id", "parent_id", "status", "provenance", F.col("kind").alias("type"), F.when(~number, column("ts_raw")).alias("timestamp"), source.alias("source"), of("message", F.col("role")).alias("role")],
            F.when(F.col("kind").isin("tool_call", "tool_result"), column("tool_name")).alias("tool_name"),
            *[of("artifact", column(n)).alias(n) for n in ("name", "uri", "mime_type", "operation")],
        )
    )
    value = F.col("value")
    error = F.concat(F.lit('{"message":'), quoted(F.col("payload")), F.coalesce(F.concat(F.lit(',"code":'), quoted(column("error_code"))), F.lit("")), F.coalesce(F.concat(F.lit(',"details":'), value), F.lit("")), F.lit("}"))
    held = F.create_map(*[F.lit(x) for x in ("message", "content", "tool_call", "arguments", "tool_result", "result", "artifact", "data", "state_change", "state")])
    more = F.concat_ws("", F.when(F.col("kind") == "error", F.concat(F.lit(',"error":'), error)).otherwise(F.concat(F.lit(',"'), F.element_at(held, F.col("kind")), F.lit('":'), value)), F.when(number, F.concat(F.lit(',"timestamp":'), column("ts_raw"))))
    return json_values.canonical_json(F.concat(F.regexp_replace(plain, r"\}$", ""), more, F.lit("}")))


def trace_hash(events: DataFrame, pairs: DataFrame, orphans: DataFrame, facts: DataFrame) -> DataFrame:
    """(trace_id, hash), a row per trace of ``facts`` (trace_id, source_format, lossy).

    SHA-256 over the key-sorted JSON of versions, format, events in order, pairs and orphans in
    order of their events, and lossy; diagnostics play no part.  ``events`` have a JSON text in value and
    those columns of :func:`events_of_opened` that apply; nested values hash alike
    whatever the order of their keys.
    """
    each = events.join(facts.select("trace_id", "source_format"), "trace_id").withColumn("sequence", F.col("sequence") if "sequence" in events.columns else F.col("ord"))
    each = each.withColumn("json", event_json(each, F.col("source_format")))
    place = each.select("trace_id", "event_id", "ord")
    listed = lambda df, json: df.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", json.alias("j")))), lambda x: x["j"]), ",").alias("j"))
    pair = F.to_json(F.struct("call_event_id", "call_id", "pair_id", "provenance", "result_event_id", "status"), {"ignoreNullFields": "false"})
    p = listed(pairs.join(place.withColumnRenamed("event_id", "call_event_id"), ["trace_id", "call_event_id"]), json_values.canonical_json(pair)).withColumnRenamed("j", "p")
    o = listed(orphans.join(place, ["trace_id", "event_id"]), quoted(F.col("event_id"))).withColumnRenamed("j", "o")
    j = facts.join(listed(each, F.col("json")), "trace_id", "left").join(p, "trace_id", "left").join(o, "trace_id", "left")
    list_of = lambda key, c: F.concat(F.lit(f'"{key}":['), F.coalesce(F.col(c), F.lit("")), F.lit("]"))
    parts = [F.lit(f'"adapter_version":"{ADAPTER_VERSION}"'), list_of("call_pairs", "p"), list_of("events", "j"), F.concat(F.lit('"lossy":'), F.col("lossy").cast("string")), list_of("orphan_result_event_ids", "o"), F.lit(f'"schema_version":"{SCHEMA_VERSION}"'), F.concat(F.lit('"source_format":'), quoted(F.col("source_format")))]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return j.select("trace_id", F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("hash"))


#: Codes that mean that something was dropped, renamed or inferred.
LOSSY = ["INVALID_JSON", "INVALID_TRACE_ROOT", "MALFORMED_EVENT", "UNSUPPORTED_EVENT", "MALFORMED_TOOL_CALL", "INCOMPLETE_STREAM_DELTA", "INFERRED_CALL_LINK", "DUPLICATE_EVENT_ID"]


def trace_summary(events: DataFrame, diagnostics: DataFrame, redactions: DataFrame | None = None) -> DataFrame:
    """(trace_id, n_events, n_diagnostics, n_errors, lossy, redacted, n_redactions), a row per trace that has an event, a diagnostic or a redaction.

    ``redactions``: (trace_id, n) rows, which are added up; without them nothing was redacted.
    """
    graded_ = graded(diagnostics)
    d = graded_.groupBy("trace_id").agg(F.count("*").alias("n_diagnostics"), F.count_if(F.col("severity") == "error").alias("n_errors"), F.bool_or(F.col("code").isin(*LOSSY)).alias("lossy"))
    e = events.groupBy("trace_id").agg(F.count("*").alias("n_events"))
    out = e.join(d, "trace_id", "full_outer")
    if redactions is not None:
        out = out.join(redactions.groupBy("trace_id").agg(F.sum("n").alias("n_redactions")), "trace_id", "full_outer")
    else:
        out = out.withColumn("n_redactions", F.lit(0).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("trace_id", zero("n_events"), zero("n_diagnostics"), zero("n_errors"), F.coalesce("lossy", F.lit(False)).alias("lossy"), (F.coalesce("n_redactions", F.lit(0)) > 0).alias("redacted"), zero("n_redactions"))


def trace_diagnostics(parsed: DataFrame, events: DataFrame, pairing: DataFrame, redactions: DataFrame | None = None) -> DataFrame:
    """(trace_id, code, severity, category, pos, path, event_ids): all that is said of traces.

    ``parsed`` are the diagnostics of parsing; ``events`` have unique ids, with renamed and first_id as
    :func:`wayline.operators.legacy.unique_event_ids` gives them; ``pairing`` is (trace_id, code, event_ids),
    ``redactions`` (trace_id, n).
    """
    nothing = F.lit(None).cast("string")
    spot = lambda df: df.withColumn("pos", F.col("pos").cast("long")) if "pos" in df.columns else df.withColumn("pos", F.lit(None).cast("long"))
    place = spot(events if "path" in events.columns else events.withColumn("path", nothing))
    renamed = place.where("renamed").select("trace_id", F.lit("DUPLICATE_EVENT_ID").alias("code"), "pos", "path", F.array("first_id", "event_id").alias("event_ids"))
    where = place.select("trace_id", F.col("event_id").alias("lead"), "pos", "path")
    paired = pairing.withColumn("lead", F.get("event_ids", 0)).join(where, ["trace_id", "lead"], "left").select("trace_id", "code", "pos", "path", "event_ids")
    out = parsed.select("trace_id", "code", "pos", "path", "event_ids").unionByName(renamed).unionByName(paired)
    if redactions is not None:
        secret = redactions.groupBy("trace_id").agg(F.sum("n").alias("n")).where("n > 0")
        out = out.unionByName(secret.select("trace_id", F.lit("REDACTED_SECRET").alias("code"), F.lit(None).cast("long").alias("pos"), nothing.alias("path"), F.lit(None).cast("array<string>").alias("event_ids")))
    return graded(out)
