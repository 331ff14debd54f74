"""Readers and writers of traces, datasets, records and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVIDENCE = "struct<line_start:bigint,line_end:bigint,quote:string,kind:string,failure:string,rationale:string>"
CASE = "struct<case_id:string,split:string,group_id:string,counterfactual_pair_id:string,style_pair_id:string,task_type:string,domain:string,style_tags:array<string>,trace:string,trace_sha256:string,source_metadata:struct<origin:string,source_id:string,legacy:boolean,development_only:boolean,unseen:boolean,notes:string>>"
LABEL = f"struct<case_id:string,reliable:boolean,primary_failure:string,failures:array<string>,gold_evidence:array<{EVIDENCE}>,required_checks:array<string>,review_status:string,annotation_notes:string>"
STEP = "struct<index:bigint,tool:string,decision:string,observation:string,status:string,duration_ms:double>"
PROGRESS = f"run_id string, seq bigint, type string, objective string, step {STEP}, report_json string, error string, ts timestamp"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """(trace_id, raw, ext), a row per file.

    A JSON file gives: a string as it is; an array's items, a line each; an object's trace,
    else its messages as ``role: content`` parted by blank lines, else the whole text.
    Other files, and JSON that doesn't parse, give their text.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("trace_id"), F.col("value").alias("text"))
    files = files.withColumn("ext", F.lower(F.regexp_extract("trace_id", r"\.([A-Za-z0-9]+)$", 1)))
    t = F.trim("text")
    ok = (F.col("ext") == "json") & F.expr("try_parse_json(text)").isNotNull()
    string = F.get_json_object(F.concat(F.lit('{"v":'), F.col("text"), F.lit("}")), "$.v")
    items = F.array_join(F.transform(F.from_json("text", "array<string>"), lambda x: x), "\n")
    messages = F.from_json(F.get_json_object("text", "$.messages"), "array<struct<role:string,content:string>>")
    rendered = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")
    raw = (
        F.when(~ok, F.col("text"))
        .when(t.startswith('"'), string)
        .when(t.startswith("["), items)
        .when(t.startswith("{"), F.coalesce(F.get_json_object("text", "$.trace"), rendered, F.col("text")))
        .otherwise(F.col("text"))
    )
    return files.select("trace_id", raw.alias("raw"), "ext")


def _read_dataset(spark: SparkSession, path: str, item: str) -> DataFrame:
    rows = spark.read.schema(f"schema_version string, dataset_id string, split string, cases array<{item}>").json(path, multiLine=True)
    named = rows.withColumnRenamed("split", "file_split")
    return named.select("dataset_id", "schema_version", "file_split", F.posexplode("cases").alias("pos", "c")).select("dataset_id", "schema_version", "file_split", F.col("pos").cast("long").alias("pos"), "c.*")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a dataset file, in file order by pos."""
    return _read_dataset(spark, path, CASE)


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Records as JSON lines; the order is kept in their pos column."""
    records.write.mode(mode).json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_document(row: DataFrame, path: str) -> None:
    """One row as one JSON document (manifests and summaries)."""
    row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def render_readiness(checks: DataFrame) -> DataFrame:
    """(value): a Markdown table of (pos, check, passed, detail) rows."""
    lines = checks.select("pos", F.format_string("| %s | %s | %s |", F.col("check"), F.when(F.col("passed"), "pass").otherwise("FAIL"), F.coalesce("detail", F.lit(""))).alias("line"))
    return lines.agg(F.concat(F.lit("| Check | Result | Detail |\n|---|---|---|\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("value"))


def format_trace(events: DataFrame) -> DataFrame:
    """(trace_id, text): a line per event by kind, with what it holds as JSON and its identities behind.

    ``events`` have a JSON text in value, and name, uri and error_code where artifacts and errors have them.
    """
    column = lambda name: F.col(name) if name in events.columns else F.lit(None).cast("string")
    named = lambda name, c: F.concat(F.lit(f"{name}="), c.cast("string"))
    sequence = F.col("sequence") if "sequence" in events.columns else F.col("ord")
    ids = F.concat_ws(" ", named("sequence", sequence), *[named(c, F.when(F.col(c) != "", F.col(c))) for c in ("event_id", "call_id", "parent_id")], named("status", F.col("status")), named("provenance", F.col("provenance")))
    value, unknown = F.coalesce("value", F.lit("null")), F.lit("unknown")
    body = (
        F.when(F.col("kind") == "message", F.concat(F.coalesce("role", unknown), F.lit(": "), value))
        .when(F.col("kind") == "tool_call", F.concat(F.lit("Tool: call "), F.coalesce("tool_name", F.lit("unknown_tool")), F.lit(" arguments="), value))
        .when(F.col("kind") == "tool_result", F.concat(F.lit("Tool: result"), F.coalesce(F.concat(F.lit(" "), "tool_name"), F.lit("")), F.lit(" result="), value))
        .when(F.col("kind") == "artifact", F.concat(F.lit("Artifact: name="), F.coalesce(column("name"), unknown), F.lit(" uri="), F.coalesce(column("uri"), unknown), F.lit(" data="), value))
        .when(F.col("kind") == "error", F.concat(F.lit("Error: "), "payload", F.lit(" code="), F.coalesce(column("error_code"), unknown)))
        .otherwise(F.concat(F.lit("State: "), value))
    )
    rows = events.select("trace_id", "ord", F.concat(body, F.lit(" ("), ids, F.lit(")")).alias("line"))
    return rows.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))


def read_progress_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The progress messages of runs, as a stream of JSON lines."""
    return spark.readStream.schema(PROGRESS).json(folder)
