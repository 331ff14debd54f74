"""Runs are taken up again without doing anything twice."""

import pytest
from pyspark.sql import functions as F

from wayline.operators import batch, runs
from wayline.operators.integrity import trace_sha


def cases(spark, n=6, text="Done, file saved."):
    return spark.createDataFrame([(f"c{i}", i, f"{text} {i}") for i in range(n)], "case_id string, pos long, trace string").withColumn("trace_sha256", trace_sha(F.col("trace")))


MANIFEST = {"run_id": "run-1", "dataset": "d"}


def test_a_rerun_adds_nothing(spark, tmp_path):
    path, seen = f"file://{tmp_path}/run", []
    def evaluator(pending):  # noqa: E306
        seen.append(sorted(r.case_id for r in pending.collect()))
        return batch.evaluate_lexical(pending)

    _, first = runs.resume_run(cases(spark), path, MANIFEST, evaluator, max_cases=2)
    records, second = runs.resume_run(cases(spark), path, MANIFEST, evaluator)
    again, third = runs.resume_run(cases(spark), path, MANIFEST, evaluator)
    assert (first, second, third) == (0, 1, None) and seen == [["c0", "c1"], ["c2", "c3", "c4", "c5"]]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, records.collect())) and {(r.case_id, r.batch) for r in again.collect()} == {(f"c{i}", 0 if i < 2 else 1) for i in range(6)}
    assert runs.committed_batches(spark, path) == [0, 1]


def test_failed_cases_are_retried_if_asked(spark, tmp_path):
    path, broken = f"file://{tmp_path}/run", {"c1", "c3"}

    def call(bad):
        def evaluator(case_id, trace):
            if case_id in bad:
                raise RuntimeError("no")
            return {"reliable": True, "reliability_score": 0.5}

        return lambda pending: batch.evaluate(pending, evaluator, attempts=1)

    got, _ = runs.resume_run(cases(spark), path, MANIFEST, call(broken))
    assert {r.case_id for r in got.collect() if r.status == "failed"} == broken
    assert runs.resume_run(cases(spark), path, MANIFEST, call(broken))[1] is None
    got, number = runs.resume_run(cases(spark), path, MANIFEST, call({"c3"}), retry_failed=True)
    assert number == 1 and got.count() == 6 and {(r.case_id, r.status, r.batch) for r in got.collect() if r.case_id in broken} == {("c1", "succeeded", 1), ("c3", "failed", 1)}


def test_what_broke_off_is_written_again(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    runs.resume_run(cases(spark), path, MANIFEST, batch.evaluate_lexical, max_cases=3)
    (tmp_path / "run" / "batch=1").mkdir()
    (tmp_path / "run" / "batch=1" / "part-0.json").write_text('{"case_id":"c3","status":"failed"}\n')  # no mark of success
    assert runs.read_run(spark, path).count() == 3
    got, number = runs.resume_run(cases(spark), path, MANIFEST, batch.evaluate_lexical)
    assert number == 1 and got.count() == 6 and {r.status for r in got.collect()} == {"succeeded"}


def test_other_runs_and_inputs_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    runs.resume_run(cases(spark), path, MANIFEST, batch.evaluate_lexical)
    with pytest.raises(ValueError, match="another run"):
        runs.resume_run(cases(spark), path, {**MANIFEST, "dataset": "e"}, batch.evaluate_lexical)
    with pytest.raises(ValueError, match="input_hash"):
        runs.resume_run(cases(spark, text="Other"), path, MANIFEST, batch.evaluate_lexical)
    runs.commit_records(runs.read_run(spark, path).limit(1).unionByName(runs.read_run(spark, path).limit(1)), path, 1)
    with pytest.raises(ValueError, match="repeated"):
        runs.resume_run(cases(spark), path, MANIFEST, batch.evaluate_lexical)


def test_empty_data_set(spark, tmp_path):
    got, number = runs.resume_run(cases(spark).limit(0), f"file://{tmp_path}/run", MANIFEST, batch.evaluate_lexical)
    assert number is None and got.count() == 0


def test_written_tables_can_be_dropped(spark, tmp_path):
    import os

    from wayline.plans import storage

    storage.drop_tables(spark)
    table = storage.materialize(cases(spark), "cases")
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert table.count() == 6 and os.path.isdir(folder) and storage.drop_tables(spark) == 1 and not os.path.exists(folder) and storage.drop_tables(spark) == 0


def test_what_is_left_is_found_without_traces(spark, tmp_path):
    """The tables of pending cases hold no traces; and a run of a few of many cases takes these only, also where most are done."""
    path, plans = f"file://{tmp_path}/run", []

    def evaluator(pending):
        plans.append(sorted(r.case_id for r in pending.collect()))
        return batch.evaluate_lexical(pending)

    before = len(getattr(spark, "_wayline_tables", []))
    for most in (4, 1, None, 3):
        got, _ = runs.resume_run(cases(spark), path, MANIFEST, evaluator, max_cases=most)
    tables = [spark.read.parquet(p) for p in spark._wayline_tables[before:]]
    assert plans == [["c0", "c1", "c2", "c3"], ["c4"], ["c5"]] and got.count() == 6
    assert [(sorted(t.columns), t.count()) for t in tables] == [(["case_id", "pos"], n) for n in (4, 1, 1, 0)]
