"""Runs that can be taken up again: a manifest, and batches of records that are committed whole or not at all."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayline.operators import batch
from wayline.plans.storage import materialize

RECORD = f"{batch.RESULT}, run_id string, input_hash string, pos bigint, batch bigint"

#: Fixed value: so many case ids are sent to all tasks.
FEW = 100_000


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path in its terms; whatever Spark can read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches under ``path`` that were written to their end."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    done = [n for n in names if n.startswith("batch=") and fs.exists(_files(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.split("=")[1]) for n in done)


def commit_records(records: DataFrame, path: str, number: int) -> None:
    """Write a batch of records as JSON lines.  A batch replaces what an attempt of the same number left, so a repeated write adds nothing."""
    records.drop("batch").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/batch={number}")


def read_run(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """The records of all committed batches; of several of one case the one of the latest batch.  Batches that broke off don't count."""
    fields = spark.createDataFrame([], schema).schema
    plain = type(fields)([f for f in fields if f.name != "batch"])
    out = spark.createDataFrame([], fields)
    for n in committed_batches(spark, path):
        out = out.unionByName(spark.read.schema(plain).json(f"{path}/batch={n}").withColumn("batch", F.lit(n).cast("long")))
    last = out.groupBy("case_id").agg(F.max("batch").alias("batch"))
    return out.join(last, ["case_id", "batch"], "left_semi").select(*fields.names)


def claim_run(spark: SparkSession, path: str, manifest: dict[str, str]) -> None:
    """Write the manifest of a run, or raise ValueError if the folder holds another run's."""
    fs, at = _files(spark, f"{path}/manifest")
    text = json.dumps(manifest, sort_keys=True)
    if fs.exists(_files(spark, f"{path}/manifest/_SUCCESS")[1]):
        if spark.read.text(f"{path}/manifest").first()["value"] != text:
            raise ValueError("the folder holds another run")
        return
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _chosen(cases: DataFrame, left: DataFrame) -> DataFrame:
    """The cases of (case_id, pos); what is null counts as equal."""
    left = left.select(F.col("case_id").alias("_id"), F.col("pos").alias("_pos"))
    return cases.join(left, F.col("case_id").eqNullSafe(F.col("_id")) & F.col("pos").eqNullSafe(F.col("_pos")), "left_semi")


def resume_run(cases: DataFrame, path: str, manifest: dict[str, str], evaluate: Callable[[DataFrame], DataFrame], retry_failed: bool = False, max_cases: int | None = None) -> tuple[DataFrame, int | None]:
    """(records, batch): evaluate what ``path`` has no record of yet, commit it, and read all records.

    ``cases``: (case_id, pos, trace, trace_sha256); ``manifest`` has a run_id; ``evaluate`` gives a
    result per case as :func:`wayline.operators.batch.evaluate` does.  A folder of another run, records of
    other inputs and repeated records of a batch raise ValueError.  batch is None if nothing
    was left to do; then nothing is written.
    """
    spark = cases.sparkSession
    claim_run(spark, path, manifest)
    earlier = read_run(spark, path)
    wrong = batch.check_records(earlier, cases, {"run_id": manifest["run_id"]}).limit(5).collect()
    if wrong:
        raise ValueError("earlier records don't match: " + ", ".join(f"{r['case_id']} {r['rule']}" for r in wrong))
    # Which cases are left is found without their traces.
    ids = cases.select("case_id", "pos")
    left = materialize(batch.pending_cases(ids, earlier, retry_failed, max_cases), "pending")
    n_left, n_done = left.count(), earlier.count()
    if not n_left:
        return earlier, None
    # The traces stay where they are if the cases to take, or those to leave out, are few.
    few = lambda df, n: F.broadcast(df) if n <= FEW else df
    pending = _chosen(cases, few(left, n_left)) if max_cases is not None or n_left <= n_done else cases.join(few(batch.done_cases(earlier, retry_failed), n_done), "case_id", "left_anti")
    number = max(committed_batches(spark, path), default=-1) + 1
    known = cases.select("case_id", F.col("trace_sha256").alias("input_hash"), F.col("pos").cast("long").alias("pos"))
    results = evaluate(pending).join(known, "case_id").withColumn("run_id", F.lit(manifest["run_id"]))
    commit_records(results, path, number)
    return read_run(spark, path), number
