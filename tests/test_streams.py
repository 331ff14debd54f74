"""Stateful streams equal their batch twins on finite input, and let go of their state."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import generic, pairing
from wayline.streaming import jobs

#: Rows of a time far behind all others; they push the watermark past the rest.
FAR = 10_000_000


def stream(spark, folder, parts, schema):
    """The parts as files of a stream, one per micro-batch, with column s as time ts."""
    frames = [spark.createDataFrame(p, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s") for p in parts]
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").json(str(folder / f"in{i}"))
    names = sorted(folder.glob("in*/part-*.json"), key=lambda p: int(p.parent.name[2:]))
    (folder / "all").mkdir()
    for i, p in enumerate(names):
        target = folder / "all" / f"{i:03d}.json"
        p.rename(target)
        import os

        os.utime(target, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).json(str(folder / "all"))


def drained(spark, df, folder, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    state = q.lastProgress["stateOperators"]
    return spark.table(name).collect(), state[0]["numRowsTotal"] if state else 0


def dealt(rows, seed=3, parts=4):
    """Rows in nearly their order, over some micro-batches."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[0] + rng.random() * 30)
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


PROGRESS = "s long, run_id string, seq long, type string, step struct<tool:string>, report_json string, error string"


def progress_rows():
    rng, rows = random.Random(5), []
    for run in range(12):
        n = rng.randrange(2, 9)
        kinds = ["agent_started"] + ["agent_step"] * n + {0: ["complete"], 1: ["error"], 2: [], 3: ["complete", "error"], 4: ["error", "agent_step", "complete"], 5: ["complete", "complete"]}[run % 6]
        rows += [(run * 40 + i * 5, f"run-{run}", i, k, (f"tool{i % 3}",) if k == "agent_step" else None, f"r{i}" if k == "complete" else None, f"boom {i}" if k == "error" else None) for i, k in enumerate(kinds)]
    return rows


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = progress_rows()
    batch = spark.createDataFrame(rows, PROGRESS).drop("s")
    expected = sorted(map(tuple, jobs.fold_progress(batch, ended=True).collect()))
    assert {r[3] for r in expected} == {"complete", "error"} and sum(r[5] == jobs.NO_REPORT for r in expected) == 2
    opened = {r.run_id: (r.outcome, r.error) for r in jobs.fold_progress(batch).collect()}
    assert opened["run-2"] == ("open", None) and opened["run-3"][0] == opened["run-4"][0] == "error" and {r[0]: r[1:3] for r in expected}["run-4"][0] == sum(x[1] == "run-4" and x[3] == "agent_step" for x in rows) - 1
    far = [[(FAR, "far", 0, "agent_started", None, None, None)], [(2 * FAR, "far", 1, "agent_started", None, None, None)]]
    got, held = drained(spark, jobs.fold_progress_stream(stream(spark, tmp_path, dealt(rows) + far, PROGRESS), "1 minute", "10 minutes"), tmp_path, "progress")
    assert sorted(tuple(r) for r in got if r.run_id != "far") == expected and held <= 1


EVENTS = "s long, trace_id string, ord long, kind string, call_id string, event_id string, parent_id string, status string, provenance string"


def event_rows():
    rng, rows = random.Random(9), []
    for t in range(6):
        for i in range(30):
            kind = rng.choice(["tool_call", "tool_result", "message"])
            call_id = rng.choice(["a", "b", None])
            calls = [r[5] for r in rows if r[1] == f"t{t}" and r[3] == "tool_call" and r[4] is None]
            parent = rng.choice(calls) if kind == "tool_result" and call_id is None and calls and rng.random() < 0.7 else None
            rows.append((i * 7, f"t{t}", i, kind, call_id, f"e{i}", parent, rng.choice(["unknown", "succeeded", "failed", "cancelled"]), rng.choice(["declared", "recorded", "verified"])))
    return rows


def test_pairing_stream_equals_batch(spark, tmp_path):
    rows = event_rows()
    e = spark.createDataFrame(rows, EVENTS).drop("s")
    pairs = pairing.pair_calls(e)
    names = ["trace_id", "pair_id", "call_id", "call_event_id", "result_event_id", "status", "provenance"]
    key = lambda r: [str(x) for x in r]
    expected = sorted((tuple(r) for r in pairs.select(*names).collect()), key=key)
    orphans = {tuple(r) for r in pairing.orphan_results(e, pairs).select("trace_id", "event_id").collect()}
    far = [[(FAR, "far", 0, "message", None, "x", None, "unknown", "recorded")], [(2 * FAR, "far", 1, "tool_call", "z", "y", None, "unknown", "recorded")], [(3 * FAR, "far", 2, "tool_call", "zz", "yy", None, "unknown", "recorded")]]
    got, _ = drained(spark, jobs.pair_calls_stream(stream(spark, tmp_path, dealt(rows) + far, EVENTS), "1 minute", "10 minutes").select(*names), tmp_path, "pairs")
    got = [r for r in got if r.trace_id != "far"]
    assert sorted((tuple(r) for r in got if r.call_event_id is not None), key=key) == expected
    assert {(r.trace_id, r.result_event_id) for r in got if r.call_event_id is None} == orphans and len(orphans) > 3 and len({r[3] for r in expected}) > 5


MESSAGES = "s long, trace_id string, pos long, item string"


def message_rows():
    item = lambda kind, i, n: {"type": f"response.output_item.{kind}", "item": {"type": "message", "id": f"i{i}", "role": "assistant", "content": f"text {n}"}}
    said = [
        [item("added", 1, 0), {"type": "response.output_text.delta", "item_id": "i1", "delta": "x"}, {"type": "response.output_text.done", "item_id": "i1", "text": "all"}, item("done", 1, 1)],
        [item("added", 2, 0), {"type": "response.output_text.delta", "item_id": "i2", "delta": "x"}, {"type": "response.output_text.delta", "item_id": "i2", "delta": "y"}],
        [{"type": "response.function_call_arguments.done", "item_id": "i3", "call_id": "k", "name": "go", "arguments": "{}"}, {"type": "response.in_progress", "response": {"id": "r", "status": "in_progress"}}, {"type": "response.failed", "response": {"error": "boom"}}, {"type": "response.output_item.done"}],
    ]
    return [(40 * t + 3 * p, f"t{t}", p, json.dumps(m)) for t in range(3) for p, m in enumerate([*said[t], *[m for other in said if other is not said[t] for m in other]])]


@pytest.mark.parametrize("part", ["items", "left"])
def test_items_stream_equals_batch(spark, tmp_path, part):
    rows = message_rows()
    which = 0 if part == "items" else 1
    columns = [["trace_id", "pos", "path", "item"], ["trace_id", "code", "pos", "path"]][which]
    expected = sorted(tuple(r) for r in generic.fold_response_stream(spark.createDataFrame(rows, MESSAGES).drop("s"))[which].select(*columns).collect())
    far = [[(FAR, "far", 0, '{"type":"response.created"}')], [(2 * FAR, "far", 1, '{"type":"response.created"}')]]
    far = [[(s, t, p, json.dumps({"type": "response.output_text.delta", "item_id": f"far{s}"})) for s, t, p, _ in f] for f in far]
    folded = jobs.fold_items_stream(stream(spark, tmp_path, dealt(rows) + far, MESSAGES), "1 minute", "10 minutes")[which]
    got, held = drained(spark, folded.select(*columns), tmp_path, f"items_{part}")
    assert sorted(tuple(r) for r in got if r.trace_id != "far") == expected and expected and held <= 1
