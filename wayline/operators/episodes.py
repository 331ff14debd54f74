"""Episode logs: which actions counted, what the files became, and the terminal reward.

``actions``: (episode_id, task_id, policy_id, step, type, path, content, report).  State is
never simulated: it is the latest admitted write of each path, found by aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayline.operators.scoring import violations
from wayline.plans.storage import materialize

TYPES = ["read_file", "write_file", "run_tests", "submit"]


def _by_step():
    return Window.partitionBy("episode_id").orderBy("step")


def check_actions(actions: DataFrame) -> DataFrame:
    """(episode_id, step, rule) of actions of an unknown type or without their fields."""
    t, r = F.col("type"), F.col("report")
    rules = {
        "type": ~F.coalesce(t.isin(*TYPES), F.lit(False)),
        "path": t.isin("read_file", "write_file") & F.col("path").isNull(),
        "content": (t == "write_file") & F.col("content").isNull(),
        "report": (t == "submit") & (r.isNull() | ~F.coalesce(r["status"].isin("completed", "partial", "blocked"), F.lit(False)) | r["artifacts"].isNull() | r["summary"].isNull()),
    }
    return violations(actions, ["episode_id", "step"], rules)


def valid_path(path: Column) -> Column:
    """Whether a path is relative, canonical and free of outer white space, backslashes and NULs."""
    clean = (F.length(path) > 0) & (F.btrim(path, F.lit(" \t\n\x0b\x0c\r ﻿")) == path) & ~path.contains("\\") & ~path.contains("\x00") & ~path.startswith("/")
    return F.coalesce(clean & ~path.rlike(r"(?:^|/)\.\.?(?:/|$)") & ~path.contains("//"), F.lit(False))


def effective_actions(actions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Actions up to the first submission, or up to the task's step limit, with end_reason."""
    submitted = F.max((F.col("type") == "submit").cast("int")).over(_by_step().rowsBetween(Window.unboundedPreceding, -1))
    rows = actions.join(tasks.select("task_id", "max_steps"), "task_id").withColumn("_done", F.coalesce(submitted, F.lit(0))).withColumn("_n", F.row_number().over(_by_step())).where("_done = 0 and _n <= max_steps")
    ended = F.max((F.col("type") == "submit").cast("int")).over(Window.partitionBy("episode_id"))
    return rows.withColumn("end_reason", F.when(ended == 1, "submitted").when(F.count("*").over(Window.partitionBy("episode_id")) >= F.col("max_steps"), "max_steps").otherwise("open")).drop("_done", "_n")


def revisions(actions: DataFrame) -> DataFrame:
    """``actions`` with admitted (a write to a valid path) and revision, the admitted writes so far."""
    rows = actions.withColumn("admitted", (F.col("type") == "write_file") & valid_path(F.col("path")) & F.col("content").isNotNull())
    return rows.withColumn("revision", F.sum(F.col("admitted").cast("long")).over(_by_step()))


def file_state(actions: DataFrame, task_files: DataFrame) -> DataFrame:
    """(episode_id, path, content): the last admitted write of every path, over the task's initial files."""
    start = actions.select("episode_id", "task_id").distinct().join(task_files, "task_id").select("episode_id", "path", "content", F.lit(-1).cast("long").alias("step"))
    writes = revisions(actions).where("admitted").select("episode_id", "path", "content", "step")
    return start.unionByName(writes).groupBy("episode_id", "path").agg(F.max_by("content", "step").alias("content"))


def content_at(rev: DataFrame, task_files: DataFrame, lookups: DataFrame) -> DataFrame:
    """``lookups`` (episode_id, task_id, path, step and more) with content: what the path held just before the step, null if it didn't exist.

    Writes and lookups of a path meet in one ordered pass; ``rev`` is as :func:`revisions` gives it.
    """
    more = [c for c in lookups.columns if c not in ("episode_id", "path", "step")]
    asks = lookups.select("episode_id", "path", "step", F.lit(None).cast("string").alias("written"), F.struct(*more).alias("ask"))
    writes = rev.where("admitted").select("episode_id", "path", "step", F.col("content").alias("written"), F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"))
    before = Window.partitionBy("episode_id", "path").orderBy("step", F.col("ask").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = writes.unionByName(asks).withColumn("written", F.last("written", ignorenulls=True).over(before)).where("ask is not null").select("episode_id", "path", "step", "written", "ask.*")
    start = task_files.select("task_id", "path", F.col("content").alias("initial"))
    return met.join(start, ["task_id", "path"], "left").select(*lookups.columns, F.coalesce("written", "initial").alias("content"))


def read_outcomes(actions: DataFrame, task_files: DataFrame) -> DataFrame:
    """(episode_id, step, path, outcome, content) of reads: found, not_found or invalid."""
    rows = content_at(revisions(actions), task_files, actions.where("type = 'read_file'").select("episode_id", "task_id", "path", "step"))
    fine = valid_path(F.col("path"))
    return rows.select("episode_id", "step", "path", F.when(~fine, "invalid").when(F.col("content").isNull(), "not_found").otherwise("found").alias("outcome"), F.when(fine, F.col("content")).alias("content"))


def eval_assertions(rev: DataFrame, task_files: DataFrame, assertions: DataFrame, moments: DataFrame) -> DataFrame:
    """(episode_id, step, assertion_id, passed) for every assertion at ``moments`` (episode_id, task_id, step): the file exists, equals, or equals as JSON whatever the order of keys, just before the step.

    ``assertions``: (task_id, assertion_id, type, path, expected).
    """
    rows = content_at(rev, task_files, moments.select("episode_id", "task_id", "step").join(assertions, "task_id"))
    canonical = lambda c: F.to_json(F.expr(f"try_parse_json({c})"))  # noqa: E731  a variant writes its keys in one order
    passed = F.when(F.col("type") == "file_exists", F.col("content").isNotNull()).when(F.col("type") == "file_equals", F.col("content") == F.col("expected")).otherwise(canonical("content") == canonical("expected"))
    return rows.select("episode_id", "step", "assertion_id", F.coalesce(passed, F.lit(False)).alias("passed"))


def test_runs(actions: DataFrame, task_files: DataFrame, assertions: DataFrame) -> DataFrame:
    """(episode_id, step, passed, revision, fresh) of test runs; fresh: no admitted write came after.

    A task without assertions passes; one with assertions and no files yet fails those.
    """
    rev = revisions(actions).withColumn("last", F.max("revision").over(Window.partitionBy("episode_id")))
    runs = rev.where("type = 'run_tests'").select("episode_id", "task_id", "step", "revision", "last")
    passed = eval_assertions(rev, task_files, assertions, runs).groupBy("episode_id", "step").agg(F.bool_and("passed").alias("passed"))
    return runs.join(passed, ["episode_id", "step"], "left").select("episode_id", "step", F.coalesce("passed", F.lit(True)).alias("passed"), "revision", (F.col("revision") == F.col("last")).alias("fresh"))


#: A step behind all others.
END = (1 << 63) - 1


def terminal_reward(actions: DataFrame, task_files: DataFrame, assertions: DataFrame) -> DataFrame:
    """A row per episode: parts of the reward, actual status, alignment of the report, and the reward.

    Artifacts count .4 by the share of passed assertions (1 without any), a fresh passing test .4, and a
    report whose status, tests claim and artifacts are all right .2.
    """
    # Actions are read once; of the states only those before the last test run and at the end are looked at.
    rev = materialize(revisions(actions).select("episode_id", "task_id", "step", "type", "path", "content", "report", "admitted", "revision"), "revisions")
    is_test = F.col("type") == "run_tests"
    base = rev.groupBy("episode_id").agg(
        F.first("task_id").alias("task_id"), F.max("revision").alias("revision"), F.count("*").alias("steps"), F.max_by("report", F.when(F.col("type") == "submit", F.col("step"))).alias("report"), F.bool_or(F.col("type") == "submit").alias("submitted"),
        F.max(F.when(is_test, F.col("step"))).alias("tested"), F.max_by("revision", F.when(is_test, F.col("step"))).alias("tested_revision"), F.collect_set(F.when(F.col("admitted"), F.col("path"))).alias("written"),
    )
    base = materialize(base, "episodes")
    moments = base.select("episode_id", "task_id", F.explode(F.array_compact(F.array(F.col("tested"), F.lit(END)))).alias("step"))
    final = F.col("step") == END
    score = eval_assertions(rev, task_files, assertions, moments).groupBy("episode_id").agg(F.avg(F.when(final, F.col("passed").cast("double"))).alias("artifacts"), F.bool_and(F.when(~final, F.col("passed"))).alias("test_passed"))
    targets = assertions.groupBy("task_id").agg(F.collect_set("path").alias("targets"))
    first_files = task_files.groupBy("task_id").agg(F.collect_set("path").alias("initial"))
    j = base.join(score, "episode_id", "left").join(targets, "task_id", "left").join(first_files, "task_id", "left")
    j = j.withColumn("paths", F.array_union("written", F.coalesce("initial", F.array().cast("array<string>")))).withColumn("test", F.when(F.col("tested").isNotNull(), F.struct(F.coalesce("test_passed", F.lit(True)).alias("passed"), (F.col("tested_revision") == F.col("revision")).alias("fresh"))))
    six = lambda c: F.round(c, 6)
    art = six(F.coalesce("artifacts", F.lit(1.0)))
    fresh = F.coalesce(F.col("test.fresh"), F.lit(False))
    passing = fresh & F.coalesce(F.col("test.passed"), F.lit(False))
    status = F.when((art == 1) & passing, "completed").when((art > 0) | (F.col("revision") > 0) | F.col("test").isNotNull(), "partial").otherwise("blocked")
    rows = j.select("episode_id", "task_id", "steps", "submitted", "report", "targets", "paths", art.alias("artifact_correctness"), passing.cast("long").alias("fresh_tests"), status.alias("actual_status"), F.when(fresh, F.col("test.passed")).alias("expected_claim"))
    claimed = F.coalesce(F.col("report.artifacts"), F.array().cast("array<string>"))
    done = F.col("submitted") & F.col("report").isNotNull()
    aligned = rows.select(
        "*",
        (done & F.coalesce(F.col("report.status") == F.col("actual_status"), F.lit(False))).alias("status_matches"),
        (done & F.col("report.tests_passed").eqNullSafe(F.col("expected_claim"))).alias("tests_claim_matches"),
        (done & (F.size(F.array_except(claimed, F.coalesce("paths", F.array().cast("array<string>")))) == 0) & ((F.col("actual_status") != "completed") | (F.size(F.array_except(F.coalesce("targets", F.array().cast("array<string>")), claimed)) == 0))).alias("artifact_claims_match"),
    )
    report = (F.col("status_matches") & F.col("tests_claim_matches") & F.col("artifact_claims_match")).cast("long")
    reward = six(six(0.4 * F.col("artifact_correctness")) + six(0.4 * F.col("fresh_tests")) + six(0.2 * report))
    return aligned.select("episode_id", "task_id", "steps", F.col("report.status").alias("claimed_status"), "actual_status", "artifact_correctness", "fresh_tests", report.alias("report_alignment"), "status_matches", "tests_claim_matches", "artifact_claims_match", reward.alias("reward"))


def scoreboard(rewards: DataFrame, policies: DataFrame) -> DataFrame:
    """(task_id, policy_id, episodes, mean_steps, mean_reward): rewards by task and policy."""
    return rewards.join(policies, "episode_id").groupBy("task_id", "policy_id").agg(F.count("*").alias("episodes"), F.avg("steps").alias("mean_steps"), F.round(F.avg("reward"), 4).alias("mean_reward"))


def step_results(actions: DataFrame, task_files: DataFrame, assertions: DataFrame) -> DataFrame:
    """(episode_id, step, type, ok, code) of every action."""
    reads = read_outcomes(actions, task_files).select("episode_id", "step", "outcome")
    tests = test_runs(actions, task_files, assertions).select("episode_id", "step", "passed")
    rows = revisions(actions).join(reads, ["episode_id", "step"], "left").join(tests, ["episode_id", "step"], "left")
    code = (
        F.when(F.col("type") == "read_file", F.concat(F.lit("read_"), F.col("outcome")))
        .when(F.col("type") == "write_file", F.when(F.col("admitted"), "written").otherwise("write_invalid"))
        .when(F.col("type") == "run_tests", F.when(F.col("passed"), "tests_passed").otherwise("tests_failed"))
        .otherwise("submitted")
    )
    return rows.select("episode_id", "step", "type", code.isin("read_found", "written", "tests_passed", "submitted").alias("ok"), code.alias("code"))


def episode_events(actions: DataFrame, tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Episodes as trace events: the request, a call and a verified result per step, and the declared report."""
    text, nothing = (lambda x: F.lit(x)), F.lit(None).cast("string")
    def event(ord_, event_id, kind, call_id, parent, status, prov, role, payload):  # noqa: E306
        return F.struct(ord_.cast("long").alias("ord"), event_id.alias("event_id"), F.lit(kind).alias("kind"), call_id.alias("call_id"), parent.alias("parent_id"), status.alias("status"), F.lit(prov).alias("provenance"), role.alias("role"), payload.alias("payload"))

    request = actions.select("episode_id", "task_id").distinct().join(tasks, "task_id").select("episode_id", event(F.lit(-1), text("request"), "message", nothing, nothing, text("unknown"), "recorded", text("user"), F.col("instruction")).alias("e"))
    s = F.col("step").cast("string")
    rows = actions.join(results.select("episode_id", "step", "ok", "code"), ["episode_id", "step"])
    call = event(F.col("step") * 2, F.concat(F.lit("call-"), s), "tool_call", F.concat(F.lit("step-"), s), text("request"), text("pending"), "recorded", nothing, F.concat_ws(" ", "type", "path"))
    result = event(F.col("step") * 2 + 1, F.concat(F.lit("result-"), s), "tool_result", F.concat(F.lit("step-"), s), nothing, F.when(F.col("ok"), "succeeded").otherwise("failed"), "verified", nothing, F.col("code"))
    report = event(F.col("step") * 2 + 1, text("report"), "message", nothing, text("request"), text("unknown"), "declared", text("assistant"), F.col("report.summary"))
    steps = rows.where("type <> 'submit'").select("episode_id", F.explode(F.array(call, result)).alias("e"))
    last = rows.where("type = 'submit'").select("episode_id", report.alias("e"))
    return request.unionByName(steps).unionByName(last).select(F.col("episode_id").alias("trace_id"), "e.*")
