"""The same operators on streams; each has a batch twin with the same result on finite input."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayline.operators import generic, pairing, scoring

LIMIT, WINDOW_S = 10, 60


def _admit_rows(times: list[float], start: float | None, used: int, limit: int, window: float):
    """Decisions for sorted request times; a window starts at a client's first request after the last one ended."""
    out = []
    for t in times:
        if start is None or t >= start + window:
            start, used = t, 1
            out.append((True, limit - 1, 0))
        elif used >= limit:
            out.append((False, 0, max(1, math.ceil(start + window - t))))
        else:
            used += 1
            out.append((True, limit - used, 0))
    return out, start, used


ADMITTED = "client_id string, ts timestamp, request_id bigint, allowed boolean, remaining bigint, retry_after bigint"


def _frame(pdf: pd.DataFrame, got) -> pd.DataFrame:
    return pd.DataFrame({"client_id": pdf["client_id"], "ts": pdf["ts"], "request_id": pdf["request_id"], "allowed": [g[0] for g in got], "remaining": [g[1] for g in got], "retry_after": [g[2] for g in got]})


def admit_batch(requests: DataFrame, limit: int = LIMIT, window: float = WINDOW_S) -> DataFrame:
    """``requests``: (client_id, ts, request_id).  Every request with allowed, remaining and retry_after seconds.

    Windows follow from one another in time, so a client's requests are walked through in
    order; clients are spread over the cluster.
    """

    def run(pdf):
        pdf = pdf.sort_values(["ts", "request_id"]).reset_index(drop=True)
        got, _, _ = _admit_rows([t.timestamp() for t in pdf["ts"]], None, 0, limit, window)
        return _frame(pdf, got)

    return requests.select("client_id", "ts", "request_id").groupBy("client_id").applyInPandas(run, ADMITTED)


def admit_stream(requests: DataFrame, limit: int = LIMIT, window: float = WINDOW_S, late: str = "10 minutes") -> DataFrame:
    """The same on a stream: a client's state is its window's start and count, and goes once the watermark is past the window.

    Requests of a client arrive in order of time across micro-batches, or up to ``late`` late.
    """

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(frames)).sort_values(["ts", "request_id"]).reset_index(drop=True)
        got, start, used = _admit_rows([t.timestamp() for t in pdf["ts"]], start, used, limit, window)
        state.update((start, used))
        state.setTimeoutTimestamp(max(int((start + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield _frame(pdf, got)

    rows = requests.select("client_id", "ts", "request_id").withWatermark("ts", late)
    return rows.groupBy("client_id").applyInPandasWithState(run, ADMITTED, "start double, used bigint", "append", GroupStateTimeout.EventTimeTimeout)


def after_quiet(rows: DataFrame, keys: list[str], fold, schema: str, ends=None, compact=None, late: str = "10 minutes", quiet: str = "30 minutes") -> DataFrame:
    """``fold(key, rows)`` of every key of a stream once no more is to come: rows as dicts in any order, a list of output rows in return.

    ``rows`` have a column ts.  A key's rows are held until the watermark, ``late`` behind the
    newest row, has passed a row that ``ends`` accepts, or ``quiet`` after its last row; then
    its state goes.  ``compact`` shortens what is held after each micro-batch.  Rows behind
    the watermark are dropped.
    """
    names = [c for c in rows.columns if c != "ts"]
    wait = pd.Timedelta(quiet).total_seconds()
    out = _names(schema)

    def run(key, frames, state: GroupState):
        held, last, ended = (json.loads(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0.0, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(fold(key, held), columns=out)
            return
        for pdf in frames:
            new = json.loads(pdf[names].to_json(orient="records"))
            held += new
            times = [t.timestamp() for t in pdf["ts"]]
            last = max([last, *times])
            finals = [t for r, t in zip(new, times) if ends and ends(r)]
            ended = max([*finals, *([] if ended is None else [ended])], default=None)
        held = compact(held) if compact else held
        state.update((json.dumps(held), last, ended))
        state.setTimeoutTimestamp(max(int(1000 * (last + wait if ended is None else max(ended, last))) + 1, state.getCurrentWatermarkMs() + 1))

    return rows.withWatermark("ts", late).groupBy(*keys).applyInPandasWithState(run, schema, "held string, last double, ended double", "append", GroupStateTimeout.EventTimeTimeout)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


NO_REPORT = "The run finished without a report."
FOLDED = "run_id string, n_steps bigint, tools string, outcome string, report_json string, error string"


def fold_progress(messages: DataFrame, ended: bool = False) -> DataFrame:
    """(run_id, n_steps, tools, outcome, report_json, error) of progress messages (run_id, seq, type, step, report_json, error).

    An error ends a run, whatever comes behind it; without one the first completion gives its
    report.  A run with neither is open, or an error if its stream has ``ended``.
    """
    step, failed, done = (F.col("type") == t for t in ("agent_step", "error", "complete"))
    got = messages.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(step, F.struct("seq", F.coalesce("step.tool", F.lit("")).alias("tool"))))).alias("steps"),
        F.min(F.when(failed, F.col("seq"))).alias("stop"),
        F.min_by(F.coalesce("error", F.lit("")), F.when(failed, F.col("seq"))).alias("error"),
        F.min_by("report_json", F.when(done, F.col("seq"))).alias("report_json"),
        F.bool_or(done).alias("done"),
    )
    steps = F.filter("steps", lambda x: F.col("stop").isNull() | (x["seq"] < F.col("stop")))
    lost = F.lit(NO_REPORT) if ended else F.lit(None).cast("string")
    return got.select(
        "run_id", F.size(steps).cast("long").alias("n_steps"), F.array_join(F.transform(steps, lambda x: x["tool"]), ",").alias("tools"),
        F.when(F.col("stop").isNotNull(), "error").when(F.col("done"), "complete").otherwise("error" if ended else "open").alias("outcome"),
        F.when(F.col("stop").isNull(), F.col("report_json")).alias("report_json"), F.when(F.col("stop").isNotNull(), F.col("error")).when(~F.col("done"), lost).alias("error"),
    )


def _folded(key, rows: list[dict]) -> list[tuple]:
    rows = sorted(rows, key=lambda r: r["seq"])
    stop = next((r for r in rows if r["type"] == "error"), None)
    done = next((r for r in rows if r["type"] == "complete"), None)
    tools = [r["tool"] or "" for r in rows if r["type"] == "agent_step" and (stop is None or r["seq"] < stop["seq"])]
    return [(key[0], len(tools), ",".join(tools), "complete" if done and not stop else "error", done["report_json"] if done and not stop else None, (stop["error"] or "") if stop else None if done else NO_REPORT)]


def fold_progress_stream(messages: DataFrame, late: str = "10 minutes", quiet: str = "30 minutes") -> DataFrame:
    """:func:`fold_progress` on a stream (with ts): a run comes out once the watermark has passed its end, or as an error after ``quiet`` without one."""
    rows = messages.select("run_id", "ts", "seq", "type", F.col("step.tool").alias("tool"), "report_json", "error")
    return after_quiet(rows, ["run_id"], _folded, FOLDED, lambda r: r["type"] in ("complete", "error"), late=late, quiet=quiet)


def _paired(key, rows: list[dict]) -> list[tuple]:
    """The k-th result with the k-th call, in order of their places; what is left of either side has no other."""
    rows = sorted(rows, key=lambda r: r["ord"])
    calls, results = ([r for r in rows if r["kind"] == k] for k in ("tool_call", "tool_result"))
    out, nothing = [], {}
    for i in range(max(len(calls), len(results))):
        c, r = calls[i] if i < len(calls) else nothing, results[i] if i < len(results) else nothing
        out.append((key[0], c.get("call_id"), c.get("event_id"), r.get("event_id"), c.get("status"), c.get("provenance"), r.get("status"), r.get("provenance")))
    return out


def pair_calls_stream(events: DataFrame, late: str = "10 minutes", quiet: str = "1 hour") -> DataFrame:
    """The pairs of :func:`wayline.operators.pairing.pair_calls` on a stream of events (with ts), and results without a call with null call_event_id and pair_id.

    An id may be used by several calls: the k-th result takes the k-th call.  The events of
    an id are held until ``quiet`` has passed without another.  A result without an id goes
    to a call without one that its parent id names.
    """
    named = F.col("call_id").isNotNull()
    key = F.when(named, F.concat(F.lit("i"), "call_id")).when(F.col("kind") == "tool_call", F.concat(F.lit("e"), "event_id")).otherwise(F.concat(F.lit("e"), F.coalesce("parent_id", F.concat(F.lit("-"), "event_id"))))
    rows = events.where(F.col("kind").isin("tool_call", "tool_result")).select("trace_id", key.alias("key"), "ts", "ord", "kind", "call_id", "event_id", "status", "provenance")
    schema = "trace_id string, call_id string, call_event_id string, result_event_id string, call_status string, call_prov string, result_status string, result_prov string"
    pairs = pairing.with_pair_status(after_quiet(rows, ["trace_id", "key"], _paired, schema, late=late, quiet=quiet))
    return pairs.withColumn("pair_id", F.when(F.col("call_event_id").isNotNull(), F.col("pair_id")))


def _surviving(rows: list[dict]) -> list[dict]:
    """Messages of an item that still count: once it is finished, only those that finish it."""
    done = [r for r in rows if r["type"] == "response.output_item.done"]
    return done or rows


def _kept_messages(key, rows: list[dict]) -> list[tuple]:
    rows = sorted(_surviving(rows), key=lambda r: r["pos"])
    done = any(r["type"] == "response.output_item.done" for r in rows)
    return [(key[0], r["pos"], r["item"], key[1], done) for r in rows]


def fold_items_stream(messages: DataFrame, late: str = "10 minutes", quiet: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """(items, diagnostics) of a stream of response messages (trace_id, pos, item, ts), as :func:`wayline.operators.generic.fold_response_stream` gives them.

    The messages of an item are held until it is finished and the watermark has passed, or
    ``quiet`` has; a finished item drops its earlier messages at once.  Messages
    without an item pass straight through; a completed response doesn't replace items that have come out already.
    """
    typed = generic.typed_messages(messages)
    schema = "trace_id string, pos bigint, item string, id string, done boolean"
    ends = lambda r: r["type"] == "response.output_item.done"
    with_id = typed.where("id is not null").select("trace_id", "id", "ts", F.col("pos").cast("long").alias("pos"), "type", "item")
    held = after_quiet(with_id, ["trace_id", "id"], _kept_messages, schema, ends, _surviving, late, quiet)
    plain = typed.where("id is null").select("trace_id", F.col("pos").cast("long").alias("pos"), "item", "id", F.lit(False).alias("done"))
    return generic.response_entries(generic.typed_messages(held.unionByName(plain).drop("id")))


def score_stream(traces: DataFrame, modes: list[str] | None = None) -> DataFrame:
    """Scores of every trace as it arrives: a projection without state."""
    return scoring.mode_scores(scoring.dimension_scores(scoring.lexical_features(traces)), modes)
