"""Coverage of datasets and readiness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayline.functions import lexicons as lex


def coverage(cases: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals per ``keys`` of cases joined with labels: rows, labels, groups, pairs."""
    return cases.groupBy(*(keys or ["split"])).agg(
        F.count("*").alias("n"),
        F.count("reliable").alias("n_labelled"),
        F.count_if("reliable").alias("n_reliable"),
        F.count_if(~F.col("reliable")).alias("n_unreliable"),
        F.countDistinct("group_id").alias("n_groups"),
        F.countDistinct("counterfactual_pair_id").alias("n_counterfactual_pairs"),
        F.countDistinct("style_pair_id").alias("n_style_pairs"),
    )


def distributions(cases: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): the marginal counts of all columns, from one pass of grouping sets."""
    sets = cases.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    ids = {c: sum(1 << (len(columns) - 1 - k) for k in range(len(columns)) if k != i) for i, c in enumerate(columns)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, g in ids.items():
        name, value = F.when(F.col("g") == g, c).otherwise(name), F.when(F.col("g") == g, F.col(c).cast("string")).otherwise(value)
    return sets.select(name.alias("column"), value.alias("value"), "n")


def readiness_checks(counts: dict[str, DataFrame], limits: dict[str, int] | None = None) -> DataFrame:
    """(check, n, passed, detail): each table of problems must have at most its limit of rows (0 by default)."""
    out = None
    for name, df in counts.items():
        most = (limits or {}).get(name, 0)
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") <= most).alias("passed"), F.format_string(f"%d rows, at most {most}", F.col("n")).alias("detail"))
        out = row if out is None else out.unionByName(row)
    return out


def _off(counts: list[Column], expected: int | None = None) -> Column:
    """How many of the counts aren't as expected (or, without a number, are zero)."""
    return sum(((c != expected) if expected is not None else (c == 0)).cast("long") for c in counts)


#: Cases outside the test split, test cases, reliable and unreliable ones, of each failure, of each domain, and pairs of both kinds.
SCAFFOLD = {"others": 24, "test": 60, "reliable": 24, "unreliable": 36, "failure": 6, "domain": 10, "counterfactual_pairs": 30, "style_pairs": 6}


def scaffold_checks(cases: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """(check, n, passed, detail): whether the corpus has the sizes, balances, tags, pairs and review states that are asked for.

    ``cases`` joined with labels: split, reliable, primary_failure, domain, style_tags, task_type, both pair ids,
    development_only, unseen, review_status.  All are counted in one pass; what is null counts as missing.
    """
    z, test = SCAFFOLD | (sizes or {}), F.col("split") == "test"
    among = lambda c: F.count_if(test & F.coalesce(c, F.lit(False)))
    pairs = lambda c: F.countDistinct(F.when(test, F.col(c)))
    hidden = F.col("development_only") & ~F.col("unseen")
    checks = {
        "dev_regression_count": (F.count_if(F.col("split") != "test"), z["others"]),
        "test_candidate_count": (F.count_if(test), z["test"]),
        "test_reliability_balance": (F.abs(among(F.col("reliable")) - z["reliable"]) + F.abs(among(~F.col("reliable")) - z["unreliable"]), 0),
        "test_primary_failure_balance": (_off([among(F.col("primary_failure") == x) for x in lex.FAILURE_LABELS], z["failure"]), 0),
        "test_domain_balance": (_off([among(F.col("domain") == x) for x in lex.DOMAINS], z["domain"]), 0),
        "test_style_coverage": (_off([among(F.array_contains("style_tags", x)) for x in lex.STYLE_TAGS]), 0),
        "combined_task_type_coverage": (_off([F.count_if(F.col("task_type") == x) for x in lex.TASK_TYPES]), 0),
        "test_pair_structure": (F.abs(pairs("counterfactual_pair_id") - z["counterfactual_pairs"]) + F.abs(pairs("style_pair_id") - z["style_pairs"]), 0),
        "candidate_visibility": (F.count_if(test & ~F.coalesce(hidden, F.lit(False))), 0),
        "review_status": (F.count_if(F.col("reliable").isNotNull() & ~F.col("review_status").eqNullSafe(F.lit("needs_human_review"))), 0),
    }
    sums = cases.agg(*[c.cast("long").alias(k) for k, (c, _) in checks.items()])
    rows = [F.struct(F.lit(k).alias("check"), F.col(k).alias("n"), (F.col(k) == m).alias("passed"), F.format_string(f"%d, expected {m}", F.col(k)).alias("detail")) for k, (_, m) in checks.items()]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def readiness_report(checks: DataFrame) -> DataFrame:
    """One row: n_checks, n_passed, ready, and the hash of all results in order of name."""
    lines = F.array_sort(F.collect_list(F.concat_ws("=", "check", F.col("passed").cast("string"))))
    return checks.agg(F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"), F.bool_and("passed").alias("ready"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))
