"""Claims, actions, and whether recorded evidence supports a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayline.functions import lexicons as lex
from wayline.functions.text import has

MAX_CLAIMS, MAX_ACTIONS, MAX_LINES, NEAR_LINES = 16, 40, 8, 14


def trace_lines(events: DataFrame) -> DataFrame:
    """(trace_id, ord, event_id, kind, role, line, quote) of every event; the line is the source's, else ord + 1.

    ``events`` needs trace_id, ord, event_id, kind, role and payload, and may have line.
    """
    line = F.coalesce("line", F.col("ord") + 1) if "line" in events.columns else F.col("ord") + 1
    return events.select("trace_id", "ord", "event_id", "kind", "role", line.cast("long").alias("line"), F.coalesce("payload", F.lit("")).alias("quote"))


def claim_kind(quote: Column) -> Column:
    return F.when(has(quote, lex.CLAIM_DONE), "completion").when(has(quote, lex.PROMISE), "promise").when(has(quote, lex.CLAIM_CONFIDENT), "confidence")


def first_rows(rows: DataFrame, most: int, order: str = "ord") -> DataFrame:
    n = F.row_number().over(Window.partitionBy("trace_id").orderBy(order))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def extract_claims(lines: DataFrame, most: int = MAX_CLAIMS) -> DataFrame:
    """(trace_id, ord, event_id, line, quote, claim) of the agent's claims, the first ``most`` of a trace."""
    claims = lines.where("kind = 'message' and role = 'assistant'").withColumn("claim", claim_kind(F.col("quote"))).where("claim is not null")
    return first_rows(claims.select("trace_id", "ord", "event_id", "line", "quote", "claim"), most)


def extract_actions(events: DataFrame, most: int = MAX_ACTIONS) -> DataFrame:
    """(trace_id, ord, event_id, line, action, status, provenance): calls, results, artifacts and failures."""
    failed = F.col("status").isin("failed", "cancelled")
    action = F.when(F.col("kind") == "error", "failure").when(F.col("kind").isin("tool_result", "artifact") & failed, "failure").when(F.col("kind").isin("tool_call", "tool_result", "artifact"), F.col("kind"))
    line = F.coalesce("line", F.col("ord") + 1) if "line" in events.columns else F.col("ord") + 1
    rows = events.withColumn("action", action).where("action is not null")
    return first_rows(rows.select("trace_id", "ord", "event_id", line.cast("long").alias("line"), "action", "status", "provenance"), most)


def support_by_distance(claims: DataFrame, actions: DataFrame, window: int = NEAR_LINES) -> DataFrame:
    """``claims`` with supported and evidence_ord: the first result or artifact at most ``window`` lines away.

    Both sides are dealt by trace and line block, and a claim looks into its own block and
    the two beside it, so a long trace is no single group of the join.
    """
    blocks = claims.withColumn("_block", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("line") / window) + d)))
    proof = actions.where("action in ('tool_result', 'artifact')").select("trace_id", F.floor(F.col("line") / window).alias("_block"), F.col("line").alias("_line"), F.col("ord").alias("_ord"))
    near = blocks.join(proof, ["trace_id", "_block"]).where(F.abs(F.col("line") - F.col("_line")) <= window).groupBy("trace_id", "ord").agg(F.min("_ord").alias("evidence_ord"))
    return claims.join(near, ["trace_id", "ord"], "left").withColumn("supported", F.col("evidence_ord").isNotNull())


def support_by_identity(claims: DataFrame, events: DataFrame, pairs: DataFrame) -> DataFrame:
    """``claims`` with supported, evidence_id and basis, by declared links alone.

    A pair is linked if its call's parent is the claim, or the claim's parent is its call or
    result; an artifact likewise.  The first successful, not merely declared pair with a
    result supports the claim, else the first such artifact; otherwise the first linked
    evidence is named as rejected.
    """
    # Calls and artifacts meet their pairs, and claims their parents, by event; each then stands under the names by which a link may find it.
    e = events.select("trace_id", "event_id", F.struct("ord", "parent_id", "kind", "status", "provenance").alias("e"))
    marks = pairs.select("trace_id", F.col("call_event_id").alias("event_id"), F.struct("pair_id", "result_event_id", "status", "provenance").alias("pair"), F.lit(False).alias("claim"))
    marks = marks.unionByName(claims.select("trace_id", "event_id", F.lit(None).cast(marks.schema["pair"].dataType).alias("pair"), F.lit(True).alias("claim")))
    met = e.join(marks, ["trace_id", "event_id"], "left").where("claim is not null or e.kind = 'artifact'")
    pair, is_pair = F.col("pair"), F.col("pair").isNotNull()
    fine = lambda x: (x["status"] == "succeeded") & (x["provenance"] != "declared")
    evidence = F.struct(F.when(is_pair, 0).otherwise(1).alias("rank"), F.col("e.ord").alias("at"), F.coalesce("pair.pair_id", "event_id").alias("evidence_id"))
    ok = F.when(is_pair, fine(pair) & F.col("pair.result_event_id").isNotNull()).otherwise(fine(F.col("e")))
    name = lambda way, c: F.struct(F.lit(way).alias("way"), c.alias("event"))
    down, up, up_too = name("parent", F.col("e.parent_id")), name("self", F.col("event_id")), name("self", F.col("pair.result_event_id"))
    found_by = met.where(is_pair | (F.col("e.kind") == "artifact")).select("trace_id", evidence.alias("evidence"), ok.alias("ok"), F.explode(F.array(down, up, up_too)).alias("link")).where("link.event is not null")
    looks_for = met.where("claim").select("trace_id", F.col("event_id").alias("claim_id"), F.explode(F.array(name("parent", F.col("event_id")), name("self", F.col("e.parent_id")))).alias("link")).where("link.event is not null")
    links = looks_for.join(found_by, ["trace_id", "link"]).select("trace_id", "claim_id", "ok", "evidence.*")
    best = links.groupBy("trace_id", "claim_id").agg(F.bool_or("ok").alias("supported"), F.min(F.when(F.col("ok"), F.struct("rank", "at", "evidence_id"))).alias("good"), F.min(F.struct("rank", "at", "evidence_id")).alias("any"))
    named = best.select("trace_id", F.col("claim_id").alias("event_id"), "supported", F.coalesce("good.evidence_id", "any.evidence_id").alias("evidence_id"))
    out = claims.join(named, ["trace_id", "event_id"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))
    return out.withColumn("basis", F.when(F.col("supported"), "supported").when(F.col("evidence_id").isNotNull(), "rejected").otherwise("none"))


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """(trace_id, n_claims, n_supported, n_unsupported)."""
    return aligned.groupBy("trace_id").agg(F.count("*").alias("n_claims"), F.count_if("supported").alias("n_supported"), F.count_if(~F.col("supported")).alias("n_unsupported"))


def masking_signals(lines: DataFrame, summary: DataFrame, most: int = MAX_LINES) -> DataFrame:
    """(trace_id, masking_lines, gap_lines, n_unsupported, elevated): line numbers of the first hits of either list.

    Elevated: any admitted gap, or masking language with an unsupported claim.
    """
    hit = lambda items: F.slice(F.transform(F.array_sort(F.collect_list(F.when(has(F.col("quote"), items), F.struct("ord", "line")))), lambda x: x["line"]), 1, most)
    found = lines.groupBy("trace_id").agg(hit(lex.MASKING).alias("masking_lines"), hit(lex.GAP).alias("gap_lines"))
    both = found.join(summary.select("trace_id", "n_unsupported"), "trace_id", "left").withColumn("n_unsupported", F.coalesce("n_unsupported", F.lit(0)))
    return both.withColumn("elevated", (F.size("gap_lines") > 0) | ((F.size("masking_lines") > 0) & (F.col("n_unsupported") > 0)))


def structure_profile(events: DataFrame, claims: DataFrame, actions: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Counts of a trace: events, turns, roles, claims, actions, failures, pairs, and events by provenance."""
    base = events.groupBy("trace_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("kind") == "message").alias("n_turns"),
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"),
        *[F.count_if(F.col("provenance") == p).alias(f"n_{p}") for p in lex.PROVENANCE_RANK],
    )
    c = claims.groupBy("trace_id").agg(F.count("*").alias("n_claims"))
    a = actions.groupBy("trace_id").agg(F.count("*").alias("n_actions"), F.count_if(F.col("action") == "failure").alias("n_failures"))
    out = base.join(c, "trace_id", "left").join(a, "trace_id", "left")
    if pairs is not None:
        out = out.join(pairs.groupBy("trace_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("result_event_id").isNotNull()).alias("n_matched")), "trace_id", "left")
    return out.fillna(0)


def evidence_sufficiency(profile: DataFrame, summary: DataFrame) -> DataFrame:
    """(trace_id, sufficient): some action, and no claim without support."""
    both = profile.select("trace_id", "n_actions").join(summary.select("trace_id", "n_unsupported"), "trace_id", "left")
    return both.select("trace_id", "n_actions", F.coalesce("n_unsupported", F.lit(0)).alias("n_unsupported"), ((F.col("n_actions") > 0) & (F.coalesce("n_unsupported", F.lit(0)) == 0)).alias("sufficient"))


def diagnostic_bundle(profile: DataFrame, summary: DataFrame, masking: DataFrame, sufficiency: DataFrame) -> DataFrame:
    """(trace_id, tool, observation): one line of text per diagnostic and trace."""
    wide = (
        profile.join(summary, "trace_id", "left").drop(summary["n_claims"]).join(masking.drop("n_unsupported"), "trace_id", "left").join(sufficiency.select("trace_id", "sufficient"), "trace_id", "left")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    texts = {
        "structure": F.concat_ws(" ", F.concat(F.lit("events="), n("n_events")), F.concat(F.lit("turns="), n("n_turns")), F.concat(F.lit("roles="), F.col("roles"))),
        "claims": F.concat(F.lit("claims="), n("n_claims")),
        "actions": F.concat_ws(" ", F.concat(F.lit("actions="), n("n_actions")), F.concat(F.lit("failures="), n("n_failures"))),
        "alignment": F.concat_ws(" ", F.concat(F.lit("supported="), n("n_supported")), F.concat(F.lit("unsupported="), n("n_unsupported"))),
        "masking": F.concat_ws(" ", F.concat(F.lit("masking="), F.size("masking_lines").cast("string")), F.concat(F.lit("gaps="), F.size("gap_lines").cast("string"))),
        "sufficiency": F.when(F.col("sufficient"), "sufficient").otherwise("insufficient"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), x.alias("observation")) for t, x in texts.items()]))
    return wide.select("trace_id", each.alias("d")).select("trace_id", "d.tool", "d.observation")


def trace_stats(traces: DataFrame) -> DataFrame:
    """(trace_id, n_lines, n_turns, n_words): lines that aren't blank, lines with a role header, words."""
    lines = F.filter(F.split("raw", "\n"), lambda x: F.trim(x) != "")
    turns = F.filter(lines, lambda x: x.rlike(r"(?i)^\s*(?:user|agent|assistant|system|tool)\s*:"))
    return traces.select("trace_id", F.size(lines).cast("long").alias("n_lines"), F.size(turns).cast("long").alias("n_turns"), F.size(F.filter(F.split("raw", r"\s+"), lambda w: w != "")).cast("long").alias("n_words"))
