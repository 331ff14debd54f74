"""Classification, ranking, evidence and pair metrics; all ratios without a denominator are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayline.functions import lexicons as lex
from wayline.operators.scoring import violations
from wayline.plans.running import running_sum


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def prf(name: str, tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [ratio(tp, tp + fp).alias(f"{name}_precision"), ratio(tp, tp + fn).alias(f"{name}_recall"), f1(tp, fp, fn).alias(f"{name}_f1")]


def binary_metrics(scored: DataFrame, gold: str = "reliable", predicted: str = "predicted_reliable", keys: list[str] | None = None) -> DataFrame:
    """Confusion, accuracy, and precision, recall, F1 of both classes; balanced accuracy and macro F1 need both."""
    g, p = F.col(gold), F.col(predicted)
    n = scored.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = n.select("*", ratio(tp + tn, F.col("n")).alias("accuracy"), *prf("reliable", tp, fp, fn), *prf("unreliable", tn, fn, fp))
    return rates.select("*", ((F.col("reliable_recall") + F.col("unreliable_recall")) / 2).alias("balanced_accuracy"), ((F.col("reliable_f1") + F.col("unreliable_f1")) / 2).alias("macro_f1"))


def _by_score(scored: DataFrame, gold: str, score: str, keys: list[str]) -> DataFrame:
    """Positives and negatives of every distinct score."""
    return scored.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(gold)).alias("p"), F.count_if(~F.col(gold)).alias("q"))


def _before(rows: DataFrame, value: str, keys: list[str], out: str, down: bool = False) -> DataFrame:
    """``rows`` with the sum of ``value`` over all lower scores (higher ones if ``down``).

    Without keys scores are dealt by ranges: distinct scores grow with the data, and a window would hold all in one task.
    """
    if keys:
        order = F.col("score").desc_nulls_last() if down else F.col("score").asc_nulls_first()
        return rows.withColumn(out, F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = rows.withColumn("_at", -F.col("score") if down else F.col("score"))
    return running_sum(at, ["_at"], value, out=out).drop("_at")


def auroc(scored: DataFrame, gold: str = "reliable", score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks; null if a score is missing or a class is empty."""
    keys = keys or []
    rows = _before(_by_score(scored, gold, score, keys), "q", keys, "below")
    out = rows.withColumn("w", F.col("p") * (F.col("below") + F.col("q") / 2)).groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"), F.count_if(F.col("score").isNull()).alias("missing"))
    return out.select(*keys, F.when(F.col("missing") == 0, ratio(F.col("w"), F.col("p") * F.col("q"))).alias("auroc"))


def auprc(scored: DataFrame, gold: str = "reliable", score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """Average precision over score thresholds, highest first; null as for :func:`auroc`."""
    keys = keys or []
    rows = _before(_before(_by_score(scored, gold, score, keys), "p", keys, "p_above", down=True), "q", keys, "q_above", down=True)
    out = rows.withColumn("tp", F.col("p_above") + F.col("p")).withColumn("fp", F.col("q_above") + F.col("q"))
    area = out.withColumn("a", F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("p").alias("p"), F.sum("q").alias("q"), F.count_if(F.col("score").isNull()).alias("missing"))
    return area.select(*keys, F.when((F.col("missing") == 0) & (F.col("q") > 0), ratio(F.col("a"), F.col("p"))).alias("auprc"))


def score_sd(scored: DataFrame, score: str = "score", keys: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(keys or [])).agg(F.count(score).alias("n_scores"), F.stddev_pop(score).alias("score_sd"))


def failure_metrics(scored: DataFrame, gold: str = "primary_failure", predicted: str = "predicted_failure") -> DataFrame:
    """(failure, tp, fp, fn, precision, recall, f1) of each label against all others, absent ones too."""
    sums = scored.agg(*[F.count_if(F.col(gold).eqNullSafe(F.lit(x)) & F.col(predicted).eqNullSafe(F.lit(x))).alias(f"{x}:tp") for x in lex.FAILURE_LABELS], *[F.count_if(~F.col(gold).eqNullSafe(F.lit(x)) & F.col(predicted).eqNullSafe(F.lit(x))).alias(f"{x}:fp") for x in lex.FAILURE_LABELS], *[F.count_if(F.col(gold).eqNullSafe(F.lit(x)) & ~F.col(predicted).eqNullSafe(F.lit(x))).alias(f"{x}:fn") for x in lex.FAILURE_LABELS])
    each = sums.select(F.explode(F.array(*[F.struct(F.lit(x).alias("failure"), *[F.col(f"`{x}:{k}`").alias(k) for k in ("tp", "fp", "fn")]) for x in lex.FAILURE_LABELS])).alias("r")).select("r.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return each.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def evidence_metrics(scored: DataFrame, gold: str = "gold_lines", predicted: str = "predicted_lines", keys: list[str] | None = None) -> DataFrame:
    """Overlap of evidence lines, summed over cases."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    n = scored.groupBy(*(keys or [])).agg(F.sum(F.size(F.array_intersect(g, p))).alias("tp"), F.sum(F.size(F.array_except(p, g))).alias("fp"), F.sum(F.size(F.array_except(g, p))).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def pair_stability(scored: DataFrame, pair: str, same_gold: bool, gold: str = "reliable", predicted: str = "predicted_reliable", keys: list[str] | None = None) -> DataFrame:
    """Pairs of two cases with equal gold (or, for counterfactuals, different gold): correct and flipped ones."""
    keys = keys or []
    pairs = scored.where(F.col(pair).isNotNull()).groupBy(*keys, pair).agg(
        F.count("*").alias("n"), F.countDistinct(gold).alias("golds"), F.bool_and(F.col(gold) == F.col(predicted)).alias("right"), (F.countDistinct(predicted) == 2).alias("flip")
    )
    ok = (F.col("n") == 2) & (F.col("golds") == (1 if same_gold else 2))
    out = pairs.groupBy(*keys).agg(F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("invalid"), F.count_if(ok & F.col("right")).alias("correct"), F.count_if(ok & F.col("flip")).alias("flips"))
    return out.select("*", ratio(F.col("correct"), F.col("eligible")).alias("accuracy"), ratio(F.col("flips"), F.col("eligible")).alias("flip_rate"))


def efficiency(scored: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, count, mean, median, p95, min, max) of the values that aren't null; p95 is the nearest rank.

    Values are counted per measure and value first, so ranks come from running sums over
    distinct values.
    """
    long = scored.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("x")).select("x.*").where("v is not null")
    by = long.groupBy("measure", "v").agg(F.count("*").alias("k"))
    run = by.withColumn("upto", F.sum("k").over(Window.partitionBy("measure").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(Window.partitionBy("measure")))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    return run.groupBy("measure").agg(
        F.max("n").alias("count"), (F.sum(F.col("v") * F.col("k")) / F.max("n")).alias("mean"), ((at(low) + at(high)) / 2).alias("median"), at(F.greatest(F.lit(1), F.ceil(F.col("n") * 0.95 - 1e-9))).alias("p95"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def pairwise_accuracy(scored: DataFrame, gold: str = "reliable", score: str = "score") -> DataFrame:
    """The share of (reliable, unreliable) pairs with a strictly higher score for the reliable one, from ranks."""
    rows = _before(_by_score(scored, gold, score, []), "q", [], "below")
    return rows.withColumn("w", F.col("p") * F.col("below")).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q")).select(ratio(F.col("w"), F.col("p") * F.col("q")).alias("accuracy"))


def check_scored(scored: DataFrame) -> DataFrame:
    """(case_id, rule) of scoring records that break a rule."""
    rules = {
        "reliable_with_failure": F.col("reliable") & F.col("primary_failure").isNotNull(),
        "unreliable_without_failure": ~F.col("reliable") & F.col("primary_failure").isNull(),
        "predicted_reliable_with_failure": F.col("predicted_reliable") & F.col("predicted_failure").isNotNull(),
        "score_range": ~F.coalesce(F.col("score").between(0, 1), F.lit(True)),
    }
    for c in ("gold_lines", "predicted_lines"):
        if c in scored.columns:
            rules[f"{c}_unique"] = F.size(F.array_distinct(c)) < F.size(c)
    repeated = scored.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("case_id_repeated").alias("rule"))
    return violations(scored, ["case_id"], rules).unionByName(repeated)
