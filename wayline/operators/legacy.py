"""Text traces: one row per line, headers, roles, inline metadata and call/result links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayline.functions.text import blank, extract, trim, words

#: The head of a line, and the words by which its content tells of a failure, a cancellation, a success or a result.
HEADER = r"(?i)^\s*(?:\[([^\]]+)\]\s*)?(user|agent|assistant|system|tool(?:\s+(?:call|result))?|artifact|error|state(?:_change)?)\s*:\s*(.*)$"
_FAILED = words(r"error|failed|failure|exception|cancelled|canceled|exit[_ ]?code\s*[=:]?\s*[1-9]\d*")
_CANCELLED = words("cancelled|canceled")
_SUCCEEDED = words(r"ok|success|succeeded|completed|exit[_ ]?code\s*[=:]?\s*0")
_RESULT = r"(?i)^(?:result|output|returned|success|succeeded|failed|failure|error)(?![A-Za-z0-9_])"


#: How a value stands behind its name, names of inline fields, and how arguments, results and a tool's name begin.
VALUE = r"""\s*[=:]\s*["']?([A-Za-z0-9_.:/\-]+)"""
FIELDS = {
    "event_id": ["event_id", "event-id"], "call_id": ["call_id", "call-id", "tool_call_id", "tool-call-id"], "parent_id": ["parent_id", "parent-id", "parent_event_id"],
    "tool": ["tool", "name"], "name": ["name", "filename"], "uri": ["uri", "url", "path"], "code": ["code"],
}
ARGUMENTS = r"(?i)(?<![A-Za-z0-9_])(?:arguments|args|input)\s*[=:]\s*(.+)$"
RESULT = r"(?i)(?<![A-Za-z0-9_])(?:result|output|value)\s*[=:]\s*(.+)$"
CALL_WORD, TOOL_WORD = r"(?i)^call\s+", r"^([A-Za-z0-9_.:/\-]+)"


def metadata(content: Column, names: list[str]) -> Column:
    """The value of the first ``name=value`` or ``name: value`` of these names; null if there is none."""
    return extract(content, r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(names) + ")" + VALUE)


def infer_status(content: Column, fallback: Column) -> Column:
    """Words of failure beat words of success; of failures, cancellation is told apart."""
    return F.when(content.rlike(_FAILED), F.when(content.rlike(_CANCELLED), "cancelled").otherwise("failed")).when(content.rlike(_SUCCEEDED), "succeeded").otherwise(fallback)


def split_lines(traces: DataFrame) -> DataFrame:
    """(trace_id, line, text, ts_raw, header, content) of every line that isn't blank; lines count from 1.

    A null trace has no lines.
    """
    rows = traces.select("trace_id", F.posexplode(F.split("raw", r"\r?\n")).alias("pos", "text")).where(~blank(F.col("text")))
    header = F.lower(extract(F.col("text"), HEADER, 2))
    return rows.select(
        "trace_id",
        (F.col("pos") + 1).cast("long").alias("line"),
        "text",
        extract(F.col("text"), HEADER, 1).alias("ts_raw"),
        header.alias("header"),
        trim(F.when(header.isNull(), F.col("text")).otherwise(F.regexp_extract("text", HEADER, 3))).alias("content"),
    )


def legacy_events(traces: DataFrame) -> DataFrame:
    """``traces``: (trace_id, raw).  One row per event, in order of ``ord``, all with provenance declared.

    Lines without a header are messages of the last message's role.  A result without a
    call id right after a call takes the call's id, or a made one that the call gets too;
    ``inferred`` marks it (such traces are lossy).
    """
    lines = split_lines(traces)
    content, header = F.col("content"), F.col("header")
    is_tool = F.coalesce(header.startswith("tool"), F.lit(False))
    kind = (
        F.when(is_tool & ((header == "tool result") | ((header == "tool") & content.rlike(_RESULT))), "tool_result")
        .when(is_tool, "tool_call")
        .when(header == "artifact", "artifact")
        .when(header == "error", "error")
        .when(header.isin("state", "state_change"), "state_change")
        .otherwise("message")
    )
    own_role = F.when(header.isin("user", "assistant", "system"), header).when(header == "agent", "assistant")
    by_line = Window.partitionBy("trace_id").orderBy("line")
    kinds = lines.withColumn("kind", kind).withColumn("ord", (F.row_number().over(by_line) - 1).cast("long"))
    named = kinds.select(
        *["trace_id", "ord", "line", "kind", "ts_raw", "text", "content"],
        F.coalesce(metadata(content, FIELDS["event_id"]), F.concat(F.lit("legacy:"), F.col("line"), F.lit(":"), F.col("kind"))).alias("event_id"),
        metadata(content, FIELDS["call_id"]).alias("own_call"),
        metadata(content, FIELDS["parent_id"]).alias("parent_id"),
        F.when(F.col("kind") == "message", F.coalesce(F.last(own_role, ignorenulls=True).over(by_line.rowsBetween(Window.unboundedPreceding, 0)), F.lit("unknown"))).alias("role"),
    )
    prev, nxt = lambda c: F.lag(c).over(by_line), lambda c: F.lead(c).over(by_line)
    made = F.concat(F.lit("legacy-call:"), F.col("line"))
    linked = named.select(
        "*",
        ((F.col("kind") == "tool_result") & F.col("own_call").isNull() & (prev("kind") == "tool_call")).alias("takes"),
        ((F.col("kind") == "tool_call") & (nxt("kind") == "tool_result") & nxt("own_call").isNull()).alias("gives"),
        F.coalesce(prev("own_call"), F.concat(F.lit("legacy-call:"), prev("line"))).alias("prev_call"),
    )
    call = F.when(F.coalesce("takes", F.lit(False)), F.col("prev_call")).when(F.coalesce("gives", F.lit(False)), F.coalesce("own_call", made)).otherwise(F.col("own_call"))
    tool = F.when(F.col("kind") == "tool_result", metadata(content, FIELDS["tool"])).when(
        F.col("kind") == "tool_call", F.coalesce(metadata(content, FIELDS["tool"]), extract(F.regexp_replace(content, CALL_WORD, ""), TOOL_WORD), F.lit("unknown_tool"))
    )
    after_tool = trim(F.expr("substring(content, locate(tool_name, content) + length(tool_name))"))
    status = (
        F.when(F.col("kind") == "tool_call", infer_status(content, F.lit("pending")))
        .when(F.col("kind").isin("tool_result", "artifact"), infer_status(content, F.lit("unknown")))
        .when(F.col("kind") == "error", "failed")
        .otherwise("unknown")
    )
    events = linked.withColumn("tool_name", tool).withColumn("status", status).withColumn("call_id", call)
    arguments = F.coalesce(extract(content, ARGUMENTS), F.nullif(after_tool, F.lit("")), content)
    result = F.coalesce(extract(content, RESULT), content)
    return events.select(
        *["trace_id", "ord", "line", "event_id", "kind", "ts_raw", "call_id", "parent_id", "status", "role", "tool_name"],
        F.lit("declared").alias("provenance"),
        F.when(F.col("kind") == "tool_call", arguments).when(F.col("kind") == "tool_result", result).otherwise(content).alias("payload"),
        F.when(F.col("kind") == "artifact", metadata(content, FIELDS["name"])).alias("name"),
        F.when(F.col("kind") == "artifact", metadata(content, FIELDS["uri"])).alias("uri"),
        F.when(F.col("kind") == "error", metadata(content, FIELDS["code"])).alias("error_code"),
        F.coalesce("takes", F.lit(False)).alias("inferred"),
    )


def unique_event_ids(events: DataFrame) -> DataFrame:
    """The n-th event of a trace with one id becomes ``id#n``; ``renamed`` marks it and ``first_id`` keeps the id that it had.  Parent references stay."""
    nth = F.row_number().over(Window.partitionBy("trace_id", "event_id").orderBy("ord"))
    rows = events.withColumn("_n", nth)
    return rows.withColumn("renamed", F.col("_n") > 1).withColumn("first_id", F.col("event_id")).withColumn("event_id", F.when(F.col("_n") > 1, F.concat_ws("#", "event_id", F.col("_n").cast("string"))).otherwise(F.col("event_id"))).drop("_n")


#: Heads of lines by which text that only looks like JSON is told to be legacy text.
LINE_HEAD = r"(?im)^(?:\[[^\]]+\]\s*)?(?:user|agent|assistant|system|tool(?:\s+(?:call|result))?|artifact|error|state(?:_change)?)\s*:"


def format_routing(traces: DataFrame) -> DataFrame:
    """(trace_id, format, invalid): format is legacy_text, generic_json or responses.

    Text that doesn't begin as JSON is legacy; JSON whose root, or one of whose items, has a
    response type, an output array or a response with one goes to responses, other JSON to
    generic; text that only looks like JSON is legacy if a line has a known head, else
    generic and invalid.
    """
    raw = trim(F.col("raw"))
    looks = F.coalesce(raw.rlike(r"^[{\[]"), F.lit(False))
    parsed = F.try_parse_json(raw)
    values = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    def is_response(x: Column) -> Column:  # noqa: E306
        kind = F.coalesce(F.get_json_object(x, "$.type"), F.get_json_object(x, "$.event"))
        lists = F.from_json(x, "output array<string>, response struct<output:array<string>>")
        return x.startswith("{") & (F.coalesce(kind.startswith("response."), F.lit(False)) | lists["output"].isNotNull() | lists["response"]["output"].isNotNull())

    headed = F.coalesce(F.col("raw").rlike(LINE_HEAD), F.lit(False))
    fmt = (
        F.when(~looks, "legacy_text")
        .when(parsed.isNull(), F.when(headed, "legacy_text").otherwise("generic_json"))
        .when(F.coalesce(F.exists(values, lambda x: F.coalesce(is_response(x), F.lit(False))), F.lit(False)), "responses")
        .otherwise("generic_json")
    )
    return traces.select("trace_id", fmt.alias("format"), (looks & parsed.isNull() & ~headed).alias("invalid"))
