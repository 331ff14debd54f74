"""Hashes, splits, duplicates, leakage, pairs and constraints of labelled datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayline.functions import lexicons as lex
from wayline.functions.json_values import canonical_json
from wayline.operators.scoring import violations

IDENTIFIER = r"^[a-z0-9]+(?:[._\-][a-z0-9]+)*$"
SHARES = {"dev": 6000, "regression": 2000, "test": 2000}


def normal_trace(c: Column) -> Column:
    """Line ends as single newlines."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def trace_sha(c: Column) -> Column:
    return F.sha2(normal_trace(c), 256)


def _actual(trace: str, sha: str | None) -> Column:
    """The hash of a trace, or the column ``sha`` that holds it already."""
    return F.col(sha) if sha else trace_sha(F.col(trace))


def check_hashes(cases: DataFrame, trace: str = "trace", stored: str = "trace_sha256", sha: str | None = None) -> DataFrame:
    """(case_id, stored, actual) of cases whose stored hash differs (null counts as different)."""
    actual = _actual(trace, sha)
    return cases.where(~actual.eqNullSafe(F.col(stored))).select("case_id", F.col(stored).alias("stored"), actual.alias("actual"))


def canonical_sha(columns: list[Column], optional: bool = False) -> Column:
    """SHA-256 of a JSON object of named columns, whatever they hold; keys are sorted as in a dictionary at every depth; nulls are written, or left out if ``optional``."""
    return F.sha2(canonical_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "true" if optional else "false"}), "letters"), 256)


def table_sha(rows: DataFrame, line: Column, counts: dict[str, Column] | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row: n, sha256 of a whole table whatever its order (put a position in ``line`` if order counts), and sums of ``counts``; with ``keys`` a row for each of their values.

    A tree: rows meet in 65,536 buckets by the first digits of their own digests, each bucket's digests are hashed in
    order, then the buckets' digests are.  Only these reach one task.
    """
    counts, keys = counts or {}, keys or []
    each = rows.select(*keys, F.sha2(line, 256).alias("h"), *[c.cast("long").alias(k) for k, c in counts.items()])
    joined = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    buckets = each.groupBy(*keys, F.substring("h", 1, 4).alias("bucket")).agg(F.count("*").alias("n"), joined(F.array_sort(F.collect_list("h"))).alias("h"), *[F.sum(k).alias(k) for k in counts])
    top = joined(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]))
    return buckets.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), top.alias("sha256"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counts])


def split_bucket(unit: Column, seed: str, buckets: int = 10_000) -> Column:
    digest = F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), unit), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % buckets


def assign_split(rows: DataFrame, seed: str, group: str | None = "group_id", shares: dict[str, int] | None = None) -> DataFrame:
    """``rows`` with bucket and split; all rows of a group fall into one split, rows without a group by their case id."""
    shares = shares or SHARES
    unit = F.concat(F.lit("case:"), F.col("case_id")) if group is None else F.coalesce(F.concat(F.lit("group:"), F.col(group)), F.concat(F.lit("case:"), F.col("case_id")))
    out, at, split = rows.withColumn("bucket", split_bucket(unit, seed, sum(shares.values()))), 0, None
    for name, share in shares.items():
        at += share
        split = F.when(F.col("bucket") < at, name) if split is None else split.when(F.col("bucket") < at, name)
    return out.withColumn("split_assigned", split)


def _values(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def check_groups(cases: DataFrame) -> DataFrame:
    """(group_id, splits, n) of groups that span several splits."""
    return cases.groupBy("group_id").agg(_values("split").alias("splits"), F.count("*").alias("n"), F.countDistinct("split").alias("_k")).where("_k > 1").drop("_k")


def check_pairs(cases: DataFrame, columns: tuple[str, ...] = ("counterfactual_pair_id", "style_pair_id")) -> DataFrame:
    """(pair_type, pair_id, n, wrong_size, crosses_splits, crosses_groups) of pairs that break a rule."""
    long = cases.select("split", "group_id", F.explode(F.array(*[F.struct(F.lit(c).alias("pair_type"), F.col(c).alias("pair_id")) for c in columns])).alias("p")).select("split", "group_id", "p.*").where("pair_id is not null")
    rows = long.groupBy("pair_type", "pair_id").agg(F.count("*").alias("n"), (F.count("*") != 2).alias("wrong_size"), (F.countDistinct("split") > 1).alias("crosses_splits"), (F.countDistinct("group_id") > 1).alias("crosses_groups"))
    return rows.where("wrong_size or crosses_splits or crosses_groups")


def find_duplicates(cases: DataFrame, trace: str = "trace", sha: str | None = None) -> DataFrame:
    """(trace_sha256, n, first_case): traces that several cases share, after line ends."""
    return cases.groupBy(_actual(trace, sha).alias("trace_sha256")).agg(F.count("*").alias("n"), F.min("case_id").alias("first_case")).where("n > 1")


def find_leakage(cases: DataFrame, trace: str = "trace", sha: str | None = None) -> DataFrame:
    """(kind, key, splits): case ids, traces, groups and pairs that occur in several splits (ids: several times)."""

    def across(key: Column, kind: str, repeated: bool = False) -> DataFrame:
        rows = cases.select(key.alias("key"), "split").where("key is not null").groupBy("key").agg(_values("split").alias("splits"), F.countDistinct("split").alias("_k"), F.count("*").alias("_n"))
        return rows.where("_n > 1" if repeated else "_k > 1").select(F.lit(kind).alias("kind"), "key", "splits")

    out = across(F.col("case_id"), "case_id", True).unionByName(across(_actual(trace, sha), "trace")).unionByName(across(F.col("group_id"), "group"))
    for c in ("counterfactual_pair_id", "style_pair_id"):
        out = out.unionByName(across(F.col(c), c))
    return out


def check_label_coverage(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """(case_id, problem): cases without a label, and labels without a case."""
    return cases.join(labels, "case_id", "left_anti").select("case_id", F.lit("missing_label").alias("problem")).unionByName(labels.join(cases, "case_id", "left_anti").select("case_id", F.lit("orphan_label").alias("problem")))


def join_cases(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases with their labels, by id; both sides' other columns must differ in name."""
    return cases.join(labels, "case_id")


def check_cases(cases: DataFrame, sha: str | None = None) -> DataFrame:
    """(case_id, rule) of cases that break a rule of the input schema; columns that are absent aren't checked."""
    has = set(cases.columns)
    rules: dict[str, Column] = {"case_id_pattern": ~F.coalesce(F.col("case_id").rlike(IDENTIFIER) & (F.length("case_id") <= 128), F.lit(False))}
    if "split" in has:
        rules["split"] = ~F.coalesce(F.col("split").isin(*lex.SPLITS), F.lit(False))
    if "group_id" in has:
        rules["group_id_pattern"] = ~F.coalesce(F.col("group_id").rlike(IDENTIFIER) & (F.length("group_id") <= 128), F.lit(False))
    if "style_tags" in has:
        rules["style_tags_unique"] = F.size(F.array_distinct("style_tags")) < F.size("style_tags")
    if "trace_sha256" in has:
        rules["trace_sha256"] = ~_actual("trace", sha).eqNullSafe(F.col("trace_sha256"))
    if {"file_split", "split"} <= has:
        rules["file_split"] = ~F.col("split").eqNullSafe(F.col("file_split"))
    repeated = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("case_id_repeated").alias("rule"))
    return violations(cases, ["case_id"], rules).unionByName(repeated)


def check_labels(labels: DataFrame) -> DataFrame:
    """(case_id, rule) of labels that break a rule.

    Reliable labels have no failures; others a primary one among their failures; every
    failure has evidence; evidence of kind support names no failure, other kinds one of the
    label's; spans run forward from line 1.
    """
    f, e = F.coalesce("failures", F.array().cast("array<string>")), F.col("gold_evidence")
    named = F.array_compact(F.transform(e, lambda x: x["failure"]))
    rules = {
        "reliable_with_failures": F.col("reliable") & ((F.size(f) > 0) | F.col("primary_failure").isNotNull()),
        "unreliable_without_failure": ~F.col("reliable") & (F.size(f) == 0),
        "primary_not_listed": F.col("primary_failure").isNotNull() & ~F.array_contains(f, F.col("primary_failure")),
        "primary_missing": ~F.col("reliable") & F.col("primary_failure").isNull(),
        "failures_unique": F.size(F.array_distinct(f)) < F.size(f),
        "failure_unknown": F.exists(f, lambda x: ~x.isin(*lex.FAILURE_LABELS)),
        "failure_without_evidence": F.size(F.array_except(f, named)) > 0,
        "evidence_failure": F.size(F.array_except(named, f)) > 0,
        "evidence_span": F.exists(e, lambda x: (x["line_start"] < 1) | (x["line_end"] < x["line_start"])),
        "support_with_failure": F.exists(e, lambda x: (x["kind"] == "support") & x["failure"].isNotNull()),
    }
    repeated = labels.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("case_id_repeated").alias("rule"))
    return violations(labels, ["case_id"], rules).unionByName(repeated)


def anchored(trace: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether a quote is in the lines from ``start`` to ``end`` of a trace; lines count from 1."""
    n = F.greatest(end - start + 1, F.lit(0)).cast("int")
    span = F.array_join(F.slice(F.split(normal_trace(trace), "\n"), F.greatest(start, F.lit(1)).cast("int"), n), "\n")
    return F.coalesce(span.contains(quote), F.lit(False))


def check_anchors(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, line_start, line_end, quote) of evidence whose quote isn't in its lines.

    ``evidence``: (case_id, line_start, line_end, quote), a row per span; lines count from 1.
    """
    holds = anchored(F.col("trace"), F.col("line_start"), F.col("line_end"), F.col("quote"))
    return evidence.join(cases.select("case_id", "trace"), "case_id").where(~holds).select("case_id", "line_start", "line_end", "quote")
