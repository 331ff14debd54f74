"""Trace-shaped views of the tables at hand, as SQL that Spark and DuckDB read alike.

The tables hold no agent traces, so traces are derived from them by fixed rules: events of
a user are a trace's events, turns of a conversation its lines, documents are cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Phrases of the derived traces, one of which every turn ends with.
PHRASES = [
    "I will check the file next.",
    "Done, the summary is saved.",
    "I am not sure about the result.",
    "The output path is listed below.",
    "Absolutely everything is complete.",
    "I did not verify the source.",
    "It is directionally reliable and accurate enough.",
    "Happy to help with the next step.",
    "The report was created and moved.",
    "You can cite the artifact.",
    "This is the important part, effectively complete.",
    "I don't have the exact figures.",
    "Nothing else needs your attention.",
    "We might return later.",
    "The task is complete.",
    "A plain remark.",
    "I'll send the screenshot, precise and exact.",
]
_CASES = "CASE " + " ".join(f"WHEN (conv_id * 7 + turn) % {len(PHRASES)} = {k} THEN " + "'" + p.replace("'", "''") + "'" for k, p in enumerate(PHRASES)) + " END"

#: Events of a user, by time: calls and results count up their ids, with gaps, repeats and missing ids at fixed places.
EV = """
ev0 AS (
  SELECT concat('u', CAST(user_id AS string)) AS trace_id, event_id AS source_id, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord,
    CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'tool_result' WHEN 'error' THEN 'error' ELSE 'artifact' END AS kind
  FROM events),
ev1 AS (
  SELECT *, sum(CASE WHEN kind = 'tool_call' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nc,
    sum(CASE WHEN kind = 'tool_result' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nr,
    max(CASE WHEN kind = 'message' THEN ord END) OVER (PARTITION BY trace_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_message,
    max(CASE WHEN kind = 'tool_call' THEN ord END) OVER (PARTITION BY trace_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_call
  FROM ev0),
ev AS (
  SELECT trace_id, CAST(ord AS bigint) AS ord, source_id, value, concat('e', CAST(ord AS string)) AS event_id, kind,
    CASE WHEN kind = 'tool_call' AND source_id % 9 <> 0 THEN concat('c', CAST(CAST(nc AS bigint) AS string))
         WHEN kind = 'tool_result' AND source_id % 11 = 0 THEN concat('x', CAST(source_id AS string))
         WHEN kind = 'tool_result' AND source_id % 7 <> 0 THEN concat('c', CAST(CAST(nr AS bigint) AS string)) END AS call_id,
    CASE WHEN kind IN ('tool_call', 'artifact') AND source_id % 3 = 0 AND last_message IS NOT NULL THEN concat('e', CAST(last_message AS string))
         WHEN kind = 'tool_result' AND source_id % 7 = 0 AND source_id % 2 = 0 AND last_call IS NOT NULL THEN concat('e', CAST(last_call AS string)) END AS parent_id,
    CASE WHEN kind = 'error' THEN 'failed' WHEN kind = 'message' THEN 'unknown' WHEN source_id % 10 = 0 THEN 'failed' WHEN source_id % 17 = 0 THEN 'cancelled'
         WHEN source_id % 5 = 1 THEN 'unknown' WHEN kind = 'tool_call' THEN 'pending' ELSE 'succeeded' END AS status,
    CASE source_id % 4 WHEN 0 THEN 'declared' WHEN 1 THEN 'verified' ELSE 'recorded' END AS provenance,
    CASE WHEN kind = 'message' THEN CASE source_id % 3 WHEN 0 THEN 'user' ELSE 'assistant' END END AS role,
    CASE WHEN kind = 'tool_call' THEN concat('tool', CAST(source_id % 6 AS string)) END AS tool_name,
    CASE source_id % 8 WHEN 0 THEN 'Done, all is saved' WHEN 1 THEN 'I will look' WHEN 2 THEN 'This is accurate' WHEN 3 THEN 'I did not open it' ELSE 'plain' END AS payload
  FROM ev1)"""

#: A line per turn of a conversation, with a role header, sometimes a tool line, and one of the phrases.
TX_LINES = f"""
tx_lines AS (
  SELECT conv_id, turn, concat(
      CASE WHEN (conv_id + turn) % 7 = 3 THEN concat('Tool call: name=search', CAST(turn % 3 AS string), ' args={{"q": ', CAST(turn AS string), '}}')
           WHEN (conv_id + turn) % 7 = 4 THEN concat('Tool result: ', CASE WHEN conv_id % 4 = 0 THEN 'failed' ELSE 'ok' END, ' output=', CAST(turn AS string))
           WHEN (conv_id + turn) % 11 = 5 THEN concat('Artifact: name=report', CAST(turn AS string), ' path=/tmp/r saved ok')
           WHEN (conv_id + turn) % 13 = 6 THEN ''
           WHEN role = 'assistant' THEN 'Agent: ' WHEN role = 'user' THEN 'User: ' ELSE 'System: ' END,
      CASE WHEN (conv_id + turn) % 7 IN (3, 4) THEN '' ELSE concat(' ', {_CASES}) END) AS line
  FROM conversations)"""

#: Documents as cases, with labels where there are any, and scores, lines and pairs by fixed rules.
CS = """
cs AS (
  SELECT d.doc_id, concat('case-', CAST(d.doc_id AS string)) AS case_id, concat('group-', d.source, '-', CAST(d.doc_id % 97 AS string)) AS group_id, d.lang AS domain, d.source, d.text AS trace, d.n_chars,
    CASE WHEN l.quality IS NULL THEN NULL ELSE l.quality = 1 AND l.toxic = 0 END AS reliable,
    CASE WHEN l.quality = 1 AND l.toxic = 0 THEN NULL WHEN l.quality IS NULL THEN NULL
         ELSE CASE d.doc_id % 6 WHEN 0 THEN 'false_completion' WHEN 1 THEN 'unsupported_claim' WHEN 2 THEN 'partial_completion_overclaim' WHEN 3 THEN 'tool_result_contradiction' WHEN 4 THEN 'artifact_provenance_mismatch' ELSE 'masking_pattern' END END AS primary_failure,
    CAST(d.doc_id * 37 % 101 AS double) / 100.0 AS score,
    (d.doc_id * 37 % 101) >= 50 AS predicted_reliable,
    CASE WHEN (d.doc_id * 37 % 101) >= 50 THEN NULL
         ELSE CASE d.doc_id % 5 WHEN 0 THEN 'false_completion' WHEN 1 THEN 'unsupported_claim' WHEN 2 THEN 'partial_completion_overclaim' WHEN 3 THEN 'tool_result_contradiction' ELSE 'masking_pattern' END END AS predicted_failure,
    CASE WHEN d.doc_id % 4 = 0 THEN concat('style-', CAST(CAST(floor(d.doc_id / 8) AS bigint) AS string)) END AS style_pair_id,
    CASE WHEN d.doc_id % 5 < 2 THEN concat('pair-', CAST(CAST(floor(d.doc_id / 5) AS bigint) AS string)) END AS counterfactual_pair_id,
    CASE WHEN d.doc_id % 10 < 6 THEN 'dev' WHEN d.doc_id % 10 < 8 THEN 'regression' ELSE 'test' END AS split
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "events")
    return spark.sql(f"WITH {EV} SELECT * FROM ev")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, raw) of the conversations."""
    register(spark, sf_dir, "conversations")
    return spark.sql(f"WITH {TX_LINES} SELECT concat('t', CAST(conv_id AS string)) AS trace_id, array_join(transform(array_sort(collect_list(struct(turn, line))), x -> x.line), chr(10)) AS raw FROM tx_lines GROUP BY conv_id")


#: The same in DuckDB, as a table of lines: (trace_id, line, text).
TX_DUCK = TX_LINES + ", tx AS (SELECT concat('t', CAST(conv_id AS string)) AS trace_id, string_agg(line, chr(10) ORDER BY turn, line) AS raw FROM tx_lines GROUP BY conv_id)"


def cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "documents", "labels")
    return spark.sql(f"WITH {CS} SELECT * FROM cs")


def cs_of(documents: DataFrame) -> DataFrame:
    """The cases of a table of documents whose text may be anything that stands for it; labels are those last registered."""
    documents.createOrReplaceTempView("documents")
    return documents.sparkSession.sql(f"WITH {CS} SELECT * FROM cs")


#: A user's events as the actions of an episode: reads, writes (some to bad paths), test runs and submissions.
AC = """
ac AS (
  SELECT concat('ep', CAST(user_id AS string)) AS episode_id, concat('task-', CAST(user_id % 3 AS string)) AS task_id, concat('policy-', CAST(user_id % 4 AS string)) AS policy_id, event_id AS source_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bigint) AS step,
    CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'write_file' WHEN 'error' THEN 'write_file' WHEN 'purchase' THEN 'run_tests' ELSE CASE WHEN event_id % 4 = 0 THEN 'submit' ELSE 'run_tests' END END AS type,
    CASE event_type WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN 'a.txt' WHEN 1 THEN 'out.txt' WHEN 2 THEN '../x' ELSE 'none.txt' END
      WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'cfg.json' ELSE 'out.txt' END WHEN 'error' THEN CASE event_id % 2 WHEN 0 THEN 'a//b' ELSE '/abs' END END AS path,
    CASE event_type WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN '{"b":1,"a":2}' ELSE concat('v', CAST(event_id % 2 AS string)) END WHEN 'error' THEN 'bad' END AS content,
    CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'partial' ELSE 'blocked' END AS report_status,
    CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS report_tests,
    CASE event_id % 7 WHEN 0 THEN 'ghost.txt' ELSE 'a.txt' END AS report_artifact
  FROM events)"""


def ac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    register(spark, sf_dir, "events")
    rows = spark.sql(f"WITH {AC} SELECT * FROM ac")
    report = F.struct(F.col("report_status").alias("status"), F.col("report_tests").alias("tests_passed"), F.array("report_artifact").alias("artifacts"), F.lit("s").alias("summary"))
    return rows.withColumn("report", F.when(F.col("type") == "submit", report)).drop("report_status", "report_tests", "report_artifact")


#: Fixture rows of the tasks; the last one starts without files.
TASK_FILES = [(f"task-{t}", "a.txt", "old") for t in range(2)]
ASSERTIONS = [(f"task-{t}", n, k, p, e) for t in range(3) for n, k, p, e in [("exists", "file_exists", "a.txt", None), ("out", "file_equals", "out.txt", "v1"), ("cfg", "json_equals", "cfg.json", '{"a":2,"b":1}')][: 3 if t else 1]]
TASKS = [(f"task-{t}", f"Do task {t}", 8 + 2 * t) for t in range(3)]


def task_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame(TASK_FILES, "task_id string, path string, content string"),
        spark.createDataFrame(ASSERTIONS, "task_id string, assertion_id string, type string, path string, expected string"),
        spark.createDataFrame(TASKS, "task_id string, instruction string, max_steps long"),
    )
