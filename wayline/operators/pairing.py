"""Tool calls and results paired by identity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wayline.functions.lexicons import PROVENANCE_RANK, STATUS_SYNONYMS
from wayline.plans.storage import materialize

_NEEDS = ["trace_id", "ord", "event_id", "kind", "call_id", "parent_id", "status", "provenance"]


def normal_status(raw: Column, is_error: Column | None = None, success: Column | None = None, fallback: str | Column = "unknown") -> Column:
    """A status from flags first, then from synonyms."""
    known = F.create_map(*[F.lit(x) for pair in STATUS_SYNONYMS.items() for x in pair])
    out = F.coalesce(F.try_element_at(known, F.lower(F.trim(raw))), fallback if isinstance(fallback, Column) else F.lit(fallback))
    if success is not None:
        out = F.when(success, "succeeded").when(~success, "failed").otherwise(out)
    return F.when(is_error, "failed").otherwise(out) if is_error is not None else out


def _in_order(key, table):
    """Contested calls of one id: results take calls in source order, those with the id the first free one, the others their parent."""
    rows = sorted(table.to_pylist(), key=lambda r: r["ord"])
    calls = [r for r in rows if r["call"]]
    taken, at, out = set(), 0, []
    for r in rows:
        if r["call"]:
            continue
        if r["target"] is not None:
            c = r["target"] if r["target"] not in taken else None
        else:
            while at < len(calls) and calls[at]["event_id"] in taken:
                at += 1
            c = calls[at]["event_id"] if at < len(calls) else None
        if c is not None:
            taken.add(c)
            out.append((key[0].as_py(), c, r["event_id"], r["status"], r["provenance"]))
    names = ["trace_id", "call_event_id", "result_event_id", "result_status", "result_prov"]
    return pa.table({n: pa.array([o[k] for o in out], pa.string()) for k, n in enumerate(names)})


def pair_calls(events: DataFrame) -> DataFrame:
    """(trace_id, pair_id, call_id, call_event_id, result_event_id, status, provenance), a row per call.

    The k-th result with a call id belongs to the k-th call of that id; a result without one
    to the call that its parent id names.  Where results of both kinds claim calls of one id
    their source order decides; only those calls are walked through, id by id.  All others
    take two exchanges: by id, where results meet calls by number, and by call, where
    results that name a parent join.  result_event_id is null for calls without a result.
    Event ids are unique in a trace.
    """
    is_call, named = F.col("kind") == "tool_call", F.col("call_id").isNotNull()
    e = events.where(F.col("kind").isin("tool_call", "tool_result") & (is_call | named | F.col("parent_id").isNotNull())).select(*_NEEDS)
    side = F.struct("ord", "event_id", "status", "provenance", "call_id")
    key = F.when(named, F.concat(F.lit("i"), "call_id")).otherwise(F.concat(F.lit("e"), "event_id"))
    rows = e.select("trace_id", key.alias("key"), is_call.alias("call"), F.when(~is_call & ~named, F.col("parent_id")).alias("parent"), side.alias("side"))
    by_id = Window.partitionBy("trace_id", "key")
    claims = F.count(F.when(~F.col("call") & F.col("parent").isNull(), 1)).over(by_id)
    nth = F.row_number().over(Window.partitionBy("trace_id", "key", "call").orderBy("side.ord"))
    met = rows.withColumn("claims", claims).withColumn("n", nth).groupBy("trace_id", "key", "n").agg(
        F.max(F.when(F.col("call"), F.col("side"))).alias("c"), F.max(F.when(~F.col("call"), F.col("side"))).alias("r"), F.max("parent").alias("parent"), F.max("claims").alias("claims")
    )
    own = F.col("c").isNotNull()
    calls = met.withColumn("target", F.coalesce("c.event_id", "parent")).where("target is not null").groupBy("trace_id", "target").agg(
        F.max("c").alias("c"), F.max(F.when(own, F.col("r"))).alias("by_id"), F.min(F.when(~own, F.col("r"))).alias("by_parent"), F.max(F.when(own, F.col("claims"))).alias("claims")
    ).where("c is not null")
    calls = materialize(calls, "calls")
    both = calls.where("by_parent is not null and c.call_id is not null and claims > 0").select("trace_id", F.col("c.call_id").alias("call_id")).distinct()
    call = calls.select("trace_id", F.col("c.call_id").alias("call_id"), F.col("c.event_id").alias("call_event_id"), F.col("c.status").alias("call_status"), F.col("c.provenance").alias("call_prov"), "c", "by_parent", F.coalesce("by_id", "by_parent").alias("r"))
    plain = call.join(both, ["trace_id", "call_id"], "left_anti").withColumns({"result_event_id": F.col("r.event_id"), "result_status": F.col("r.status"), "result_prov": F.col("r.provenance")}).drop("c", "by_parent", "r")
    contested = call.join(both, ["trace_id", "call_id"], "left_semi")
    results = e.where(~is_call & named).join(both, ["trace_id", "call_id"], "left_semi")
    turn = lambda df, at, call_, target: df.select("trace_id", "call_id", F.col(f"{at}ord").alias("ord"), F.col(f"{at}event_id").alias("event_id"), F.col(f"{at}status").alias("status"), F.col(f"{at}provenance").alias("provenance"), F.lit(call_).alias("call"), target.cast("string").alias("target"))
    turns = turn(contested, "c.", True, F.lit(None)).unionByName(turn(contested.where("by_parent is not null"), "by_parent.", False, F.col("call_event_id"))).unionByName(turn(results, "", False, F.lit(None)))
    walked = turns.groupBy("trace_id", "call_id").applyInArrow(_in_order, "trace_id string, call_event_id string, result_event_id string, result_status string, result_prov string")
    return with_pair_status(plain.unionByName(contested.drop("c", "by_parent", "r").join(walked, ["trace_id", "call_event_id"], "left")))


def with_status(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Pairs of all calls with status and weakest provenance; see :func:`pair_calls`."""
    c = events.where("kind = 'tool_call'").select("trace_id", F.col("event_id").alias("call_event_id"), "call_id", F.col("status").alias("call_status"), F.col("provenance").alias("call_prov"))
    r = events.where("kind = 'tool_result'").select("trace_id", F.col("event_id").alias("result_event_id"), F.col("status").alias("result_status"), F.col("provenance").alias("result_prov"))
    return with_pair_status(c.join(matches, ["trace_id", "call_event_id"], "left").join(r, ["trace_id", "result_event_id"], "left"))


def with_pair_status(rows: DataFrame) -> DataFrame:
    """Pairs (call_event_id, result_event_id, call_status, call_prov, result_status, result_prov) with id, status and weakest provenance."""
    worst = lambda s: (F.col("call_status") == s) | F.coalesce(F.col("result_status") == s, F.lit(False))
    known = F.coalesce(F.col("result_status"), F.lit("unknown"))
    status = F.when(worst("failed"), "failed").when(worst("cancelled"), "cancelled").when(known != "unknown", F.col("result_status")).otherwise(F.col("call_status"))
    rank = F.create_map(*[F.lit(x) for p in PROVENANCE_RANK.items() for x in p])
    weakest = F.when(F.col("result_prov").isNull() | (F.try_element_at(rank, "call_prov") <= F.try_element_at(rank, "result_prov")), F.col("call_prov")).otherwise(F.col("result_prov"))
    return rows.select("trace_id", F.concat_ws("::", "call_event_id", F.coalesce("result_event_id", F.lit("unmatched"))).alias("pair_id"), "call_id", "call_event_id", "result_event_id", status.alias("status"), weakest.alias("provenance"))


def orphan_results(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """(trace_id, event_id, code) of results that no call took."""
    matched = pairs.where("result_event_id is not null").select("trace_id", F.col("result_event_id").alias("event_id"))
    named = F.col("call_id").isNotNull() | F.col("parent_id").isNotNull()
    return events.where("kind = 'tool_result'").join(matched, ["trace_id", "event_id"], "left_anti").select("trace_id", "event_id", F.when(named, "ORPHAN_TOOL_RESULT").otherwise("MISSING_CALL_ID").alias("code"))


def pairing_diagnostics(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """(trace_id, code, event_ids): calls without a result, calls and results without an id, results that no call took, and ids of several calls.

    event_ids names the event, or all calls of one id in order.
    """
    one = lambda df, code: df.select("trace_id", code.alias("code"), F.array("event_id").alias("event_ids"))
    open_calls = pairs.where("result_event_id is null").withColumn("event_id", F.col("call_event_id"))
    calls = events.where("kind = 'tool_call'")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "event_id"))), lambda x: x["event_id"])
    double = calls.where("call_id is not null").groupBy("trace_id", "call_id").agg(in_order.alias("event_ids")).where("size(event_ids) > 1").select("trace_id", F.lit("DUPLICATE_CALL_ID").alias("code"), "event_ids")
    return one(open_calls, F.lit("UNMATCHED_TOOL_CALL")).unionByName(one(calls.where("call_id is null"), F.lit("MISSING_CALL_ID"))).unionByName(double).unionByName(one(orphan_results(events, pairs), F.col("code")))


def evidence_for_parent(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """(trace_id, parent_event_id, pair_id): pairs whose call names an event as its parent."""
    calls = events.where("kind = 'tool_call' and parent_id is not null").select("trace_id", F.col("event_id").alias("call_event_id"), F.col("parent_id").alias("parent_event_id"))
    return pairs.join(calls, ["trace_id", "call_event_id"]).select("trace_id", "parent_event_id", "pair_id")
