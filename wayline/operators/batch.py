"""Batch evaluation: run identity, resume, evaluators, judge requests, gold join and summaries."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wayline.operators import integrity, metrics, scoring
from wayline.operators.scoring import violations


def run_manifest(cases: DataFrame, config: dict[str, str]) -> DataFrame:
    """One row: case count, hash of all cases with their positions, hashes of the configuration, and the run id."""
    base = integrity.table_sha(cases, F.concat_ws("|", F.col("pos").cast("string"), "case_id", "trace_sha256"))
    out = base.select(F.col("n").alias("n_cases"), F.col("sha256").alias("dataset_sha256"), *[F.sha2(F.lit(v), 256).alias(f"{k}_sha256") for k, v in sorted(config.items())])
    return out.withColumn("run_id", F.concat(F.lit("run-"), F.substring(F.sha2(F.concat_ws("|", *[c for c in out.columns if c.endswith("sha256")]), 256), 1, 16)))


def done_cases(records: DataFrame, retry_failed: bool = False) -> DataFrame:
    """(case_id) of the records that need no other try."""
    return (records.where("status = 'succeeded'") if retry_failed else records).select("case_id")


def pending_cases(cases: DataFrame, records: DataFrame, retry_failed: bool = False, max_cases: int | None = None) -> DataFrame:
    """Cases without a record (or with a failed one, if asked), the first ``max_cases`` in order of position."""
    left = cases.join(done_cases(records, retry_failed), "case_id", "left_anti")
    return left.orderBy("pos").limit(max_cases) if max_cases is not None else left


def check_records(records: DataFrame, cases: DataFrame, run: dict[str, str]) -> DataFrame:
    """(case_id, rule): records of other inputs or configurations, of unknown cases, and repeated ones."""
    known = cases.select("case_id", F.col("trace_sha256").alias("_sha"))
    j = records.join(known, "case_id", "left")
    rules = {"unknown_case": F.col("_sha").isNull(), "input_hash": ~F.col("input_hash").eqNullSafe(F.col("_sha")) & F.col("_sha").isNotNull()} | {k: ~F.col(k).eqNullSafe(F.lit(v)) for k, v in run.items()}
    repeated = records.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("repeated").alias("rule"))
    return violations(j, ["case_id"], rules).unionByName(repeated)


def evaluate_lexical(cases: DataFrame, mode: str = "research", text: str = "trace") -> DataFrame:
    """The built-in evaluator as expressions: case_id, status, attempts, and the prediction."""
    scores = scoring.mode_scores(scoring.dimension_scores(scoring.lexical_features(cases, text)), [mode])
    out = scoring.to_prediction(scoring.explain(scores))
    return out.select("case_id", F.lit("succeeded").alias("status"), F.lit(1).cast("long").alias("attempts"), "reliable", "primary_failure", "reliability_score", F.lit(None).cast("string").alias("error"))


RESULT = "case_id string, status string, attempts bigint, reliable boolean, primary_failure string, reliability_score double, error string"


def evaluate(cases: DataFrame, evaluator: Callable[[str, str], dict], attempts: int = 2, text: str = "trace") -> DataFrame:
    """Results of a callable (case_id, trace) -> prediction, tried up to ``attempts`` times per case.

    A case whose evaluator keeps raising, or returns what breaks the rules, is a failed
    record with its error; it never fails the job.
    """
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for case_id, trace in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = None
                for n in range(1, attempts + 1):
                    try:
                        p = evaluator(case_id, trace)
                        s = p.get("reliability_score")
                        if not isinstance(p.get("reliable"), bool) or (s is not None and not 0 <= s <= 1) or (p["reliable"] and p.get("primary_failure")) or p.get("fallback"):
                            raise ValueError("the result breaks a rule")
                        row = (case_id, "succeeded", n, p["reliable"], p.get("primary_failure"), s, None)
                        break
                    except Exception as e:  # noqa: BLE001  any error of a user's callable is that case's error
                        row = (case_id, "failed", n, None, None, None, f"{type(e).__name__}: {e}")
                out.append(row)
            types = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return cases.select("case_id", text).mapInArrow(run, RESULT)


def check_results(results: DataFrame) -> DataFrame:
    """(case_id, rule) of succeeded results that break a rule."""
    ok = F.col("status") == "succeeded"
    return violations(results, ["case_id"], {
        "score_range": ok & ~F.coalesce(F.col("reliability_score").between(0, 1), F.lit(True)),
        "reliable_missing": ok & F.col("reliable").isNull(),
        "reliable_with_failure": ok & F.col("reliable") & F.col("primary_failure").isNotNull(),
    })


def judge_requests(traces: DataFrame, text: str = "trace", key: str = "case_id") -> DataFrame:
    """(key, request): numbered lines as JSON, with <, > and & escaped."""
    numbered = F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")
    body: Column = F.to_json(F.struct(numbered.alias("trace")))
    for a, b in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return traces.select(key, body.alias("request"))


JUDGMENT = "reliable boolean, primary_failure string, reliability_score double, rationale string"


def ingest_judgments(outputs: DataFrame, key: str = "case_id", text: str = "output") -> DataFrame:
    """(key, judgment columns, valid): texts that parse and keep the rules; others are kept as invalid."""
    j = outputs.withColumn("_j", F.from_json(text, JUDGMENT)).select(key, "_j.*")
    valid = F.col("reliable").isNotNull() & F.coalesce(F.col("reliability_score").between(0, 1), F.lit(False)) & F.coalesce(F.length("rationale") <= 2000, F.lit(True)) & ~(F.col("reliable") & F.col("primary_failure").isNotNull())
    return j.withColumn("valid", F.coalesce(valid, F.lit(False)))


def join_gold(records: DataFrame, labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """Succeeded records with gold verdict and gold_lines, the distinct lines of all their spans.

    ``evidence``: (case_id, line_start, line_end), ends included.  missing_label marks records without a label.
    """
    lines = evidence.where("line_end >= line_start").select("case_id", F.explode(F.sequence("line_start", "line_end")).alias("line")).groupBy("case_id").agg(F.array_sort(F.collect_set("line")).alias("gold_lines"))
    gold = labels.select("case_id", F.col("reliable").alias("gold_reliable"), F.col("primary_failure").alias("gold_failure"))
    out = records.where("status = 'succeeded'").join(gold, "case_id", "left").join(lines, "case_id", "left")
    return out.withColumn("gold_lines", F.coalesce("gold_lines", F.array().cast("array<bigint>"))).withColumn("missing_label", F.col("gold_reliable").isNull())


def run_summary(cases: DataFrame, records: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """One row: cases, records by status, run status, and accuracy figures if gold is given."""
    n = records.agg(F.count("*").alias("n_records"), F.count_if(F.col("status") == "succeeded").alias("n_succeeded"), F.count_if(F.col("status") == "failed").alias("n_failed")).join(cases.agg(F.count("*").alias("n_cases")))
    status = F.when(F.col("n_succeeded") == F.col("n_cases"), "complete").when(F.col("n_succeeded") > 0, "partial").otherwise("failed")
    out = n.withColumn("status", status)
    return out if scored is None else out.join(metrics.binary_metrics(scored, "gold_reliable", "reliable").select("accuracy", "balanced_accuracy", "macro_f1"))


def run_telemetry(calls: DataFrame) -> DataFrame:
    """(run_id, n_calls, tokens, complete, returned_model, model_ms) of model calls; missing counts as 0 but isn't complete."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")]
    whole = F.bool_and(F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull() & F.col("total_tokens").isNotNull())
    last = F.max_by("returned_model", F.when(F.length("returned_model") > 0, F.col("index")))
    return calls.groupBy("run_id").agg(F.count("*").alias("n_calls"), *sums, whole.alias("complete"), last.alias("returned_model"), F.sum("latency_ms").alias("model_ms"))


def run_quality(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, degraded, reasons, tier).  ``runs``: (run_id, lossy, source_format, reached_limit); ``steps``: (run_id, tool, status)."""
    s = steps.groupBy("run_id").agg(F.countDistinct("tool").alias("n_tools"), F.bool_or(F.col("tool") == "detect_strategic_masking").alias("masking"), F.bool_or(F.col("status") == "failed").alias("failed"))
    j = runs.join(s, "run_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("lossy"), "lossy_trace"), F.when(F.col("source_format") == "legacy_text", "legacy_declared_fallback"), F.when(F.col("failed"), "diagnostic_tool_failure"), F.when(F.col("reached_limit"), "step_limit_reached")))
    tier = F.when(F.col("masking") | (F.col("n_tools") >= 5), "deep").when(F.col("n_tools") >= 3, "standard").otherwise("light")
    return j.select("run_id", (F.size(reasons) > 0).alias("degraded"), F.array_join(reasons, ",").alias("reasons"), tier.alias("tier"))

