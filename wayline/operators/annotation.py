"""Blinded double annotation: item ids, lines, disagreements and agreement figures; artifacts are in :mod:`wayline.operators.artifacts`.

Decisions: (item_id, decision_status, reliable, primary_failure, failures, evidence,
required_checks), a row per item; evidence is an array of any comparable type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayline.operators.integrity import normal_trace, trace_sha
from wayline.operators.metrics import ratio

VERSION = "1.0.0"


def sha_parts(*parts: Column) -> Column:
    """SHA-256 of texts with a NUL between them."""
    nul = F.char(F.lit(0))
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, nul, p)
    return F.sha2(joined, 256)


def blind_ids(cases: DataFrame, dataset_sha256: str, version: str = VERSION) -> DataFrame:
    """``cases`` (case_id, trace) with item_id, which tells nothing of the case."""
    digest = sha_parts(F.lit(version), F.lit(dataset_sha256), F.col("case_id"), trace_sha(F.col("trace")))
    return cases.withColumn("item_id", F.concat(F.lit("item-"), F.substring(digest, 1, 24)))


def packet_lines(items: DataFrame, text: str = "trace") -> DataFrame:
    """(item_id, line_number, text): lines from 1."""
    return items.select("item_id", F.posexplode(F.split(normal_trace(F.col(text)), "\n")).alias("p", "text")).select("item_id", (F.col("p") + 1).cast("long").alias("line_number"), "text")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    cols = ["decision_status", "reliable", "primary_failure", "failures", "evidence", "required_checks"]
    side = lambda df, s: df.select("item_id", *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return side(a, "a").join(side(b, "b"), "item_id").withColumn("comparable", (F.col("decision_status_a") == "final") & (F.col("decision_status_b") == "final"))


def _differs(c: str, as_set: bool = True) -> Column:
    a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
    return ~F.array_sort(a).eqNullSafe(F.array_sort(b)) if as_set else ~a.eqNullSafe(b)


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(item_id, reasons) of items on which two responses differ; the order of evidence plays no part."""
    j = _both(a, b)
    named = {"binary_reliability": _differs("reliable", False), "primary_failure": _differs("primary_failure", False), "failure_set": _differs("failures"), "evidence": _differs("evidence"), "required_checks": _differs("required_checks")}
    reasons = F.when(~F.col("comparable"), F.array(F.lit("non_final"))).otherwise(F.array_compact(F.array(*[F.when(v, n) for n, v in named.items()])))
    return j.select("item_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def cohen_kappa(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: comparable, agreements, raw_agreement, cohen_kappa, kappa_status."""
    x, y = F.col("reliable_a"), F.col("reliable_b")
    n = _both(a, b).where("comparable").agg(F.count("*").alias("comparable"), F.count_if(x == y).alias("agreements"), F.count_if(x).alias("pa"), F.count_if(y).alias("pb"))
    pa_, pb = ratio(F.col("pa"), F.col("comparable")), ratio(F.col("pb"), F.col("comparable"))
    rows = n.select("comparable", "agreements", ratio(F.col("agreements"), F.col("comparable")).alias("raw_agreement"), (pa_ * pb + (1 - pa_) * (1 - pb)).alias("e"))
    flat = F.abs(1 - F.col("e")) < 16 * 2.220446049250313e-16
    status = F.when(F.col("comparable") == 0, "no_comparable_items").when(flat, "degenerate_no_variance").otherwise("computed")
    return rows.select("comparable", "agreements", "raw_agreement", F.when(~flat, (F.col("raw_agreement") - F.col("e")) / (1 - F.col("e"))).alias("cohen_kappa"), status.alias("kappa_status"))


def multilabel_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: comparable, exact_sets, exact_set_agreement, mean_jaccard; two empty sets agree fully."""
    fa, fb = F.array_distinct("failures_a"), F.array_distinct("failures_b")
    j = F.coalesce(F.try_divide(F.size(F.array_intersect(fa, fb)).cast("double"), F.size(F.array_union(fa, fb))), F.lit(1.0))
    n = _both(a, b).where("comparable").agg(F.count("*").alias("comparable"), F.count_if(~_differs("failures")).alias("exact_sets"), F.avg(j).alias("mean_jaccard"))
    return n.select("comparable", "exact_sets", ratio(F.col("exact_sets"), F.col("comparable")).alias("exact_set_agreement"), "mean_jaccard")


def compare_annotations(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of all agreement figures."""
    return cohen_kappa(a, b).join(multilabel_agreement(a, b).drop("comparable")).join(_both(a, b).agg(F.count("*").alias("items"))).join(disagreements(a, b).agg(F.count("*").alias("disagreements")))
