"""Whole-group bootstrap: draws from a counter-based generator, replicates, percentile intervals."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wayline.functions import lexicons as lex
from wayline.operators import metrics
from wayline.plans.running import running_sum

#: The generator's step, its word size, and the shifts and masks of :func:`uniform`.
_STEP, _MASK = 0x6D2B79F5, 0xFFFFFFFF


def seed_state(seed: str) -> int:
    return int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16) or _STEP


def _mul(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of 32-bit numbers, without leaving 64 bits."""
    m = F.lit(_MASK)
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a.bitwiseAND(F.lit(0xFFFF)) * b + high).bitwiseAND(m)


def uniform(k: Column, seed: str) -> Column:
    """The k-th number (from 1) of the generator, in [0, 1); its state is linear in k."""
    m = F.lit(_MASK)
    s = (F.lit(seed_state(seed)) + k.cast("long") % (1 << 31) * F.lit(_STEP)).bitwiseAND(m)
    v = _mul(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    w = v.bitwiseXOR((v + _mul(v.bitwiseXOR(F.shiftright(v, 7)), v.bitwiseOR(F.lit(61)))).bitwiseAND(m))
    return w.bitwiseXOR(F.shiftright(w, 14)).cast("double") / float(1 << 32)


def bootstrap_draws(spark: SparkSession, groups: int, iterations: int, seed: str) -> DataFrame:
    """(iteration, draw, group_index): ``groups`` draws with replacement in each iteration."""
    n = max(groups, 1)
    rows = spark.range(iterations * groups)
    return rows.select(F.floor(F.col("id") / n).cast("long").alias("iteration"), (F.col("id") % n).alias("draw"), F.floor(uniform(F.col("id") + 1, seed) * n).cast("long").alias("group_index"))


def group_index(scored: DataFrame, collation: str | None = "UNICODE") -> DataFrame:
    """(group_id, group_index) in collation order, by running counts over groups (a row per group), in many tasks."""
    order = F.collate(F.col("group_id"), collation) if collation else F.col("group_id")
    groups = scored.select("group_id").distinct().select("group_id", order.alias("order"), F.lit(1).cast("long").alias("one"))
    return running_sum(groups, ["order", "group_id"], "one", out="group_index").select("group_id", "group_index")


#: Costs whose means are among the series.
MEANS = ["latency_ms", "total_tokens", "tool_calls"]


def _series(columns: set[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """(sums, values): what is summed over the cases of a group, and the metrics that the sums of a sample give."""
    g, p = F.col("reliable"), F.col("predicted_reliable")
    sums = {"tp": F.count_if(g & p), "fp": F.count_if(~g & p), "fn": F.count_if(g & ~p), "tn": F.count_if(~g & ~p)}
    tp, fp, fn, tn = (F.col(c) for c in sums)
    half = lambda a, b: (a + b) / 2
    values = {"balanced_accuracy": half(metrics.ratio(tp, tp + fn), metrics.ratio(tn, tn + fp)), "macro_f1": half(metrics.f1(tp, fp, fn), metrics.f1(tn, fn, fp))}
    if {"gold_lines", "predicted_lines"} <= columns:
        a, b = F.array_distinct("gold_lines"), F.array_distinct("predicted_lines")
        sums |= {"lines_both": F.sum(F.size(F.array_intersect(a, b))), "lines_gold": F.sum(F.size(a)), "lines_predicted": F.sum(F.size(b))}
        values |= {f"evidence_line_{n}": metrics.ratio(F.col("lines_both"), F.col(f"lines_{of}")) for n, of in (("precision", "predicted"), ("recall", "gold"))}
    for m in MEANS:
        if m in columns:
            sums |= {f"{m}_sum": F.sum(F.col(m).cast("double")), f"{m}_n": F.count(m)}
            values[f"mean_{m}"] = metrics.ratio(F.col(f"{m}_sum"), F.col(f"{m}_n"))
    if {"primary_failure", "predicted_failure"} <= columns:
        for x in lex.FAILURE_LABELS:
            named, said = F.col("primary_failure").eqNullSafe(F.lit(x)), F.col("predicted_failure").eqNullSafe(F.lit(x))
            sums |= {f"{x}_both": F.count_if(named & said), f"{x}_one": F.count_if(named != said)}
            values[f"failure_{x}_f1"] = metrics.ratio(2 * F.col(f"{x}_both"), 2 * F.col(f"{x}_both") + F.col(f"{x}_one"))
    return sums, values


def _long(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()])
    return rows.select("iteration", F.explode(each).alias("r")).select("iteration", "r.*")


def bootstrap_metrics(scored: DataFrame, iterations: int, seed: str, collation: str | None = "UNICODE") -> DataFrame:
    """(iteration, metric, value) of every replicate; iteration -1 is the sample itself.

    Counts are summed per group before they meet the draws; ranks come from counts per
    group and score; pairs keep their draw, so that two draws of a group are two pairs.
    Series whose columns ``scored`` lacks (lines, costs, failures, pairs) are left out;
    ranks are null in a sample with a missing score.
    """
    index = group_index(scored, collation)
    groups = index.count()
    draws = bootstrap_draws(scored.sparkSession, groups, iterations, seed)
    own = index.select(F.lit(-1).cast("long").alias("iteration"), F.lit(-1).cast("long").alias("draw"), "group_index")
    drawn = draws.unionByName(own)
    rows = scored.join(index, "group_id")
    g = F.col("reliable")
    sums, values = _series(set(scored.columns))
    per_group = rows.groupBy("group_index").agg(*[c.alias(n) for n, c in sums.items()])
    out = _long(drawn.join(per_group, "group_index").groupBy("iteration").agg(*[F.sum(n).alias(n) for n in sums]), values)
    scores = rows.groupBy("group_index", "score").agg(F.count_if(g).alias("p"), F.count_if(~g).alias("q"))
    ranked = drawn.join(scores, "group_index").groupBy("iteration", "score").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("iteration").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    down = Window.partitionBy("iteration").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    # The deviations need the mean of the sample first: one more window over the same rows.
    whole, k = Window.partitionBy("iteration"), F.when(F.col("score").isNotNull(), F.col("p") + F.col("q")).otherwise(0)
    mean = F.try_divide(F.sum(F.col("score") * k).over(whole), F.sum(k).over(whole))
    areas = ranked.withColumn("w", F.col("p") * (below + F.col("q") / 2)).withColumn("a", F.col("p") * F.sum("p").over(down) / (F.sum("p").over(down) + F.sum("q").over(down))).withColumn("k", k).withColumn("d", F.pow(F.col("score") - mean, 2) * k)
    rank = areas.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in ("w", "a", "p", "q", "k", "d")])
    known = F.col("k") == F.col("p") + F.col("q")
    out = out.unionByName(_long(rank, {
        "auroc": F.when(known, metrics.ratio(F.col("w"), F.col("p") * F.col("q"))),
        "auprc": F.when(known & (F.col("q") > 0), metrics.ratio(F.col("a"), F.col("p"))),
        "score_sd": F.sqrt(metrics.ratio(F.col("d"), F.col("k"))),
    }))
    if "style_pair_id" in scored.columns:
        pairs = drawn.join(rows.where("style_pair_id is not null").select("group_index", "style_pair_id", "reliable", "predicted_reliable"), "group_index")
        s = metrics.pair_stability(pairs.withColumn("pair", F.concat_ws("#", "style_pair_id", F.col("draw").cast("string"))), "pair", True, keys=["iteration"])
        out = out.unionByName(_long(s, {"style_pair_accuracy": F.col("accuracy"), "label_flip_rate": F.col("flip_rate")}))
    return out


def bootstrap_intervals(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """(metric, estimate, lower, upper, valid_samples), by linear interpolation between order statistics."""
    tail = (1 - level) / 2
    rep = F.when(F.col("iteration") >= 0, F.col("value"))
    return replicates.groupBy("metric").agg(F.max(F.when(F.col("iteration") < 0, F.col("value"))).alias("estimate"), F.percentile(rep, F.lit(tail)).alias("lower"), F.percentile(rep, F.lit(1 - tail)).alias("upper"), F.count(rep).alias("valid_samples"))
