"""Queries over episodes, annotation, batch runs, JSON traces and the batch twins of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import annotation, artifacts, batch, episodes, generic, legacy, pairing, runs
from wayline.operators.integrity import trace_sha
from wayline.plans import views
from wayline.plans.trace_queries import ORACLE_SQL as TRACE_SQL, PAIRS, SRC_EV
from wayline.plans.storage import materialize, new_table_path
from wayline.streaming import jobs

# -- episodes


def _eff(s, d):
    return episodes.effective_actions(views.ac(s, d), views.task_tables(s)[2])


def _reward(s, d):
    files, asserts, _ = views.task_tables(s)
    return episodes.terminal_reward(_eff(s, d), files, asserts)


def scoreboard(s, d):
    e = _eff(s, d)
    return episodes.scoreboard(_reward(s, d), e.select("episode_id", "policy_id").distinct())


def step_results(s, d):
    files, asserts, _ = views.task_tables(s)
    return episodes.step_results(_eff(s, d), files, asserts)


def episode_events(s, d):
    return episodes.episode_events(_eff(s, d), views.task_tables(s)[2], step_results(s, d))


def episode_pairs(s, d):
    """Episodes as traces, their calls paired with their results."""
    p = pairing.pair_calls(materialize(episode_events(s, d), "episodes"))
    return p.groupBy("status", "provenance").agg(F.count("*").alias("n"))


def _values(rows) -> str:
    q = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in rows)


EFF = f"""{views.AC}, tasks(task_id, instruction, max_steps) AS (VALUES {_values(views.TASKS)}), tf(task_id, path, content) AS (VALUES {_values(views.TASK_FILES)}), ta(task_id, assertion_id, type, path, expected) AS (VALUES {_values(views.ASSERTIONS)}),
x AS (SELECT ac.*, max_steps, coalesce(max(CASE WHEN type = 'submit' THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM ac JOIN tasks USING (task_id)),
eff AS (SELECT * FROM x WHERE done = 0 AND step < max_steps),
rev AS (SELECT *, (type = 'write_file' AND path NOT IN ('a//b', '/abs')) AS admitted, CAST(sum(CASE WHEN type = 'write_file' AND path NOT IN ('a//b', '/abs') THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY step) AS bigint) AS revision FROM eff),
w AS (SELECT episode_id, path, content, -1 AS step FROM (SELECT DISTINCT episode_id, task_id FROM eff) JOIN tf USING (task_id) UNION ALL SELECT episode_id, path, content, step FROM rev WHERE admitted),
final AS (SELECT episode_id, path, arg_max(content, step) AS content FROM w GROUP BY 1, 2),
state AS (SELECT e.episode_id, e.task_id, e.step, w.path, arg_max(w.content, w.step) AS content FROM eff e JOIN w ON w.episode_id = e.episode_id AND w.step < e.step WHERE e.type IN ('run_tests', 'read_file') GROUP BY 1, 2, 3, 4),
runs AS (SELECT r.episode_id, r.step, r.revision, r.revision = (max(r.revision) OVER (PARTITION BY r.episode_id)) AS maybe, r.type, bool_and(coalesce(CASE a.type WHEN 'file_exists' THEN state.content IS NOT NULL WHEN 'file_equals' THEN state.content = a.expected ELSE state.content = '{{"b":1,"a":2}}' END, false)) AS passed
  FROM rev r LEFT JOIN ta a ON a.task_id = r.task_id LEFT JOIN state ON state.episode_id = r.episode_id AND state.step = r.step AND state.path = a.path GROUP BY 1, 2, 3, 5),
tests AS (SELECT * FROM runs WHERE type = 'run_tests'),
art AS (SELECT e.episode_id, avg(CASE WHEN coalesce(CASE a.type WHEN 'file_exists' THEN f.content IS NOT NULL WHEN 'file_equals' THEN f.content = a.expected ELSE f.content = '{{"b":1,"a":2}}' END, false) THEN 1.0::double ELSE 0.0::double END) AS artifacts
  FROM (SELECT DISTINCT episode_id, task_id FROM eff) e JOIN ta a USING (task_id) LEFT JOIN final f ON f.episode_id = e.episode_id AND f.path = a.path GROUP BY 1),
b AS (SELECT episode_id, any_value(task_id) AS task_id, any_value(policy_id) AS policy_id, max(revision) AS revision, count(*) AS steps, bool_or(type = 'submit') AS submitted, arg_max(report_status, step) FILTER (type = 'submit') AS rs, arg_max(source_id, step) FILTER (type = 'submit') AS rid FROM rev GROUP BY 1),
l AS (SELECT episode_id, arg_max(passed, step) AS passed, arg_max(maybe, step) AS fresh FROM tests GROUP BY 1),
c AS (SELECT b.*, round(artifacts, 6) AS art, coalesce(fresh, false) AS fr, coalesce(fresh, false) AND coalesce(passed, false) AS passing, passed, l.fresh IS NOT NULL AS tested, CASE rid % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS claim, rid % 7 = 0 AS ghost FROM b JOIN art USING (episode_id) LEFT JOIN l USING (episode_id)),
st AS (SELECT *, CASE WHEN art = 1 AND passing THEN 'completed' WHEN art > 0 OR revision > 0 OR tested THEN 'partial' ELSE 'blocked' END AS actual FROM c),
al AS (SELECT *, submitted AND coalesce(rs = actual, false) AS m1, submitted AND claim IS NOT DISTINCT FROM CASE WHEN fr THEN passed END AS m2, submitted AND EXISTS (SELECT 1 FROM final f WHERE f.episode_id = st.episode_id AND f.path = CASE WHEN ghost THEN 'ghost.txt' ELSE 'a.txt' END) AND (actual <> 'completed' OR task_id = 'task-0') AS m3 FROM st),
reward AS (SELECT episode_id, task_id, policy_id, steps, rs AS claimed_status, actual AS actual_status, art AS artifact_correctness, passing::bigint AS fresh_tests, (m1 AND m2 AND m3)::bigint AS report_alignment, m1 AS status_matches, m2 AS tests_claim_matches, m3 AS artifact_claims_match,
  round(round(0.4::double * art, 6) + round(0.4::double * passing::bigint, 6) + round(0.2::double * (m1 AND m2 AND m3)::bigint, 6), 6) AS reward FROM al)"""

# -- annotation

DATASET = "0" * 64


#: Test cases whose texts name their own identifiers.
TC = "tc AS (SELECT doc_id, case_id, group_id, style_pair_id, counterfactual_pair_id, source AS source_id, concat(trace, chr(10), 'Seen in ', case_id, ' of ', group_id, ' from ', source, CASE WHEN style_pair_id IS NULL THEN '' ELSE concat(' with ', style_pair_id) END, '.') AS trace, reliable, CAST(floor(doc_id / 10) AS bigint) % 24 AS v FROM cs WHERE split = 'test' AND reliable IS NOT NULL)"


def decision_rows(side: str) -> str:
    """What an annotator says of the test cases: b differs from a at fixed places, and some decisions break a rule."""
    b = side == "b"
    return f"""dec_{side} AS (SELECT *, CASE WHEN v IN (1, 2) THEN 'abstain' WHEN v = 15 THEN 'maybe' WHEN {"doc_id % 19 = 0" if b else "v = 16"} THEN 'ambiguous' ELSE 'final' END AS status,
    CASE WHEN v IN (1, 3{"" if b else ", 16"}) THEN NULL {"WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN NOT reliable" if b else ""} ELSE reliable END AS rel FROM tc),
  de_{side} AS (SELECT *, CASE WHEN rel OR rel IS NULL THEN CASE WHEN v = 4 THEN 'masking_pattern' END WHEN v = 5 THEN NULL ELSE 'masking_pattern' END AS primary_failure, CASE WHEN rel OR rel IS NULL THEN NULL WHEN v = 6 THEN 'unsupported_claim' ELSE 'masking_pattern' END AS f1, CASE WHEN v = 7 AND NOT rel THEN 'masking_pattern' WHEN {"doc_id % 5 = 3" if b else "false"} AND NOT rel THEN 'false_completion' END AS f2,
    CASE WHEN v = 3 THEN 0 WHEN v = 8 THEN 1 ELSE 2 END AS shape, CASE WHEN v = 15 THEN 'odd' WHEN v = 12 OR (rel IS NULL AND v <> 2) THEN 'context' WHEN rel THEN 'supports_reliability' ELSE 'supports_failure' END AS kind,
    CASE WHEN v = 11 THEN NULL WHEN v = 12 OR NOT rel THEN 'masking_pattern' END AS e_failure, CASE WHEN v = 15 THEN 1.5 ELSE 0.5 END AS confidence, CASE WHEN v = 1 {"OR doc_id % 19 = 0" if b else "OR v = 16"} THEN 'why' END AS notes FROM dec_{side})"""


def _cases_of(s, d, side: str):
    views.register(s, d, "documents", "labels")
    rows = s.sql(f"WITH {views.CS}, {TC}, {decision_rows(side)} SELECT * FROM de_{side}")
    return annotation.blind_ids(rows, DATASET)


def _items(s, d):
    return materialize(artifacts.packet_items(_cases_of(s, d, "a")), "items")


def _decisions(s, d, side: str, items=None):
    """Decisions on the items, with one piece of evidence: the last line of the blinded text, but for those that break a rule."""
    items = _items(s, d) if items is None else items
    v, last = F.col("v"), F.col("n_lines")
    rows = _cases_of(s, d, side).join(items.select("item_id", F.size("lines").cast("long").alias("n_lines"), F.element_at("lines", -1)["text"].alias("line")), "item_id")
    start, end = F.when(v == 9, last - 1).otherwise(last), F.when(v == 8, last + 1).when(v == 10, last - 1).otherwise(last)
    quote = F.when(v == 9, F.concat("line", F.lit("!"))).when(v == 15, "").otherwise(F.col("line"))
    piece = F.struct(start.alias("line_start"), end.alias("line_end"), quote.alias("quote"), F.col("kind"), F.col("e_failure").alias("failure"), F.lit("seen there").alias("rationale"))
    checks = F.when((v == 3) | (F.col("rel").isNull() & (v != 2)), F.array()).when(v == 7, F.array(F.lit("claim_support"), F.lit("claim_support"))).otherwise(F.array(F.lit("claim_support"))).cast("array<string>")
    return rows.select("item_id", "doc_id", "v", F.col("status").alias("decision_status"), F.col("rel").alias("reliable"), "primary_failure", F.array_compact(F.array("f1", "f2")).alias("failures"), F.when(F.col("shape") == 0, F.array()).otherwise(F.array(piece)).cast(f"array<{artifacts.EVIDENCE}>").alias("evidence"), checks.alias("required_checks"), F.col("confidence").cast("double").alias("confidence"), "notes")


_ANNOTATORS = ("annotator-a", "annotator-b")


def _packets(s, d, items):
    headers, listed = artifacts.build_packets(items, "set-1", DATASET, "seed", _ANNOTATORS, "v1", "2026-01-01T00:00:00Z")
    return materialize(headers, "headers"), materialize(listed, "listed")


def response_violations(s, d):
    """Responses of both annotators; b's names another packet, a's lack some items and repeat others."""
    items = _items(s, d)
    headers, listed = _packets(s, d, items)
    responses = headers.select("annotator_id", "packet_id", F.when(F.col("annotator_id") == "annotator-b", F.lit("0" * 64)).otherwise(F.col("packet_sha256")).alias("packet_sha256"), "dataset_id", "dataset_sha256", F.when(F.col("annotator_id") == "annotator-b", "v2").otherwise(F.col("codebook_version")).alias("codebook_version"), F.lit("2026-01-02T00:00:00+01:00").alias("submitted_at"))
    a = _decisions(s, d, "a", items).where("v <> 13")
    said = a.unionByName(a.where("v = 14")).withColumn("annotator_id", F.lit("annotator-a")).unionByName(_decisions(s, d, "b", items).withColumn("annotator_id", F.lit("annotator-b")))
    return artifacts.check_responses(responses, said.drop("v", "doc_id"), headers, listed)


def packet_violations(s, d):
    """Packets of which one is changed: a line, a hash, an item less and one more."""
    items = _items(s, d)
    headers, listed = _packets(s, d, items)
    n = F.pmod(F.conv(F.substring("item_id", 6, 6), 16, 10).cast("long"), F.lit(11))
    own = F.col("annotator_id") == "annotator-b"
    bad = listed.where(~own | (n != 0)).withColumn("lines", F.when(own & (n == 1), F.slice(F.col("lines"), 1, F.size("lines") - 1)).when(own & (n == 2), F.transform("lines", lambda x: F.struct((x["line_number"] + 1).alias("line_number"), x["text"].alias("text")))).otherwise(F.col("lines")))
    bad = bad.withColumn("item_id", F.when(own & (n == 3), F.concat("item_id", F.lit("x"))).otherwise(F.col("item_id")))
    return artifacts.check_packet(headers, bad, items, "set-1", DATASET)


def packet_hashes(s, d):
    headers, _ = _packets(s, d, _items(s, d))
    return headers.select("annotator_id", "packet_id", "packet_sha256")


def _resolutions(s, d, a, b):
    """What the adjudicator says: A's decision, or a judgment that differs from it where it claims not to."""
    chosen = annotation.disagreements(a, b).select("item_id").join(a, "item_id").withColumn("resolution", F.when(F.col("doc_id") % 2 == 0, "annotation_a").otherwise("independent_judgment"))
    return chosen.withColumn("primary_failure", F.when((F.col("doc_id") % 4 == 0) & (F.size("failures") > 0), "artifact_provenance_mismatch").otherwise(F.col("primary_failure"))).withColumns({"rationale": F.when(F.col("doc_id") % 9 != 0, "seen"), "adjudicator_id": F.lit("adjudicator-c")})


def adjudication_violations(s, d):
    items = _items(s, d)
    a, b = (materialize(_decisions(s, d, x, items), "decisions") for x in "ab")
    header = s.createDataFrame([("set-1", DATASET, "v1", *_ANNOTATORS)], "dataset_id string, dataset_sha256 string, codebook_version string, annotator_a string, annotator_b string")
    head, disputed = artifacts.adjudication_packet(a, b, items, header, "adjudicator-c", "2026-01-03T00:00:00Z")
    head, disputed = materialize(head, "head"), materialize(disputed, "disputed")
    response = head.select("adjudicator_id", "packet_id", "packet_sha256", F.lit("0" * 64).alias("comparison_sha256"), "dataset_id", "dataset_sha256", "codebook_version")
    return artifacts.check_adjudication(response, _resolutions(s, d, a, b).where("doc_id % 8 <> 1").drop("doc_id", "v"), head, disputed)


def _frozen(s, d):
    items = _items(s, d)
    a, b = (materialize(_decisions(s, d, x, items), "decisions") for x in "ab")
    return artifacts.freeze_labels(a, b, _resolutions(s, d, a, b), items)


def freeze_manifest(s, d):
    facts = s.createDataFrame([("set-1", DATASET, "v1", *_ANNOTATORS, "adjudicator-c", "1" * 64, "2" * 64, None, "2026-01-04T00:00:00Z", None, "accepted", "fine")], "dataset_id string, dataset_sha256 string, codebook_version string, annotator_a string, annotator_b string, adjudicator_id string, response_sha256_a string, response_sha256_b string, adjudication_sha256 string, generated_at string, accepted_at string, acceptance_status string, acceptance_notes string")
    m = materialize(artifacts.freeze_manifest(_frozen(s, d), facts), "manifest")
    return m.crossJoin(artifacts.check_manifest(m).groupBy().agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("broken"))).select("items", "agreed", "adjudicated", "label_sha256", "broken")


def agreement(s, d):
    items = _items(s, d)
    return annotation.compare_annotations(_decisions(s, d, "a", items), _decisions(s, d, "b", items))


def disagreements(s, d):
    items = _items(s, d)
    return annotation.disagreements(_decisions(s, d, "a", items), _decisions(s, d, "b", items)).select("item_id", F.array_join("reasons", ",").alias("reasons"))


def frozen(s, d):
    e = F.element_at("gold_evidence", 1)
    return _frozen(s, d).select("case_id", "reliable", "primary_failure", F.array_join("failures", ",").alias("failures"), e["quote"].alias("quote"), e["line_start"].alias("line_start"), F.size("gold_evidence").cast("long").alias("n_evidence"), "review_status", "resolution", "decision_sha256", "adjudicator_id")


_ID = f"'item-' || substr(sha256(encode('1.0.0') || '\\x00'::blob || encode('{DATASET}') || '\\x00'::blob || encode(case_id) || '\\x00'::blob || encode(sha256(regexp_replace(trace, '\\r\\n?', chr(10), 'g')))), 1, 24)"
_REF = lambda name: f"'ref-' || substr(sha256(encode(item_id) || '\\x00'::blob || encode('{name}')), 1, 20)"


def _said(side: str) -> str:
    return f"""{side} AS (SELECT i.item_id, i.case_id, d.doc_id, d.v, status AS st, rel AS r, primary_failure AS f, list_filter([f1, f2], lambda x: x IS NOT NULL) AS fl, CASE WHEN d.v = 3 OR (rel IS NULL AND d.v <> 2) THEN 0 WHEN d.v = 7 THEN 2 ELSE 1 END AS n_checks, confidence, notes, shape > 0 AS has, kind, e_failure AS ef, ls,
      CASE WHEN d.v = 9 THEN len(ls) - 1 ELSE len(ls) END AS e0, CASE WHEN d.v = 8 THEN len(ls) + 1 WHEN d.v = 10 THEN len(ls) - 1 ELSE len(ls) END AS e1, CASE WHEN d.v = 9 THEN ls[-1] || '!' WHEN d.v = 15 THEN '' ELSE ls[-1] END AS quote,
      '{{"decision_status":"' || status || '","evidence":[' || CASE WHEN shape > 0 THEN '{{"failure":' || coalesce('"' || e_failure || '"', 'null') || ',"kind":"' || kind || '","line_end":' || e1 || ',"line_start":' || e0 || ',"quote":"' || quote || '","rationale":"seen there"}}' ELSE '' END || '],"failures":[' || coalesce(array_to_string(list_transform(list_sort(fl), lambda x: '"' || x || '"'), ','), '')
      || '],"primary_failure":' || coalesce('"' || primary_failure || '"', 'null') || ',"reliable":' || coalesce(rel::varchar, 'null') || ',"required_checks":[' || CASE n_checks WHEN 0 THEN '' WHEN 1 THEN '"claim_support"' ELSE '"claim_support","claim_support"' END || ']}}' AS j FROM de_{side} d JOIN items i USING (doc_id))"""


_ITEMS = f"""it0 AS (SELECT *, {_ID} AS item_id FROM tc),
items AS (SELECT *, string_split(text, chr(10)) AS ls, sha256(text) AS sha FROM (SELECT *, replace(replace(replace(replace(replace(regexp_replace(trace, '\\r\\n?', chr(10), 'g'), group_id, {_REF('group')}), case_id, item_id), coalesce(style_pair_id, '~none~'), {_REF('style')}), coalesce(counterfactual_pair_id, '~none~'), {_REF('counterfactual')}), source_id, {_REF('source')}) AS text FROM it0))"""
AB = f"""{views.CS}, {TC}, {decision_rows("a")}, {decision_rows("b")}, {_ITEMS}, {_said("a")}, {_said("b")},
ab AS (SELECT a.item_id, a.case_id, a.doc_id, a.st = 'final' AND b.st = 'final' AS fin, a.r AS ra, b.r AS rb, a.f AS fa, b.f AS fb, a.fl AS la, b.fl AS lb, a.n_checks AS ca, b.n_checks AS cb, CASE WHEN a.has THEN (a.e0, a.e1, a.quote, a.kind, a.ef) END AS ea, CASE WHEN b.has THEN (b.e0, b.e1, b.quote, b.kind, b.ef) END AS eb FROM a JOIN b USING (item_id)),
dis AS (SELECT *, CASE WHEN NOT fin THEN ['non_final'] ELSE list_filter([CASE WHEN ra IS DISTINCT FROM rb THEN 'binary_reliability' END, CASE WHEN fa IS DISTINCT FROM fb THEN 'primary_failure' END, CASE WHEN list_sort(la) <> list_sort(lb) THEN 'failure_set' END, CASE WHEN ea IS DISTINCT FROM eb THEN 'evidence' END, CASE WHEN ca <> cb THEN 'required_checks' END], lambda x: x IS NOT NULL) END AS reasons FROM ab),
kap AS (SELECT count(*) AS comparable, count(*) FILTER (ra = rb) AS agreements, (count(*) FILTER (ra = rb))::double / count(*) AS raw_agreement, (count(*) FILTER (ra))::double / count(*) AS pa, (count(*) FILTER (rb))::double / count(*) AS pb,
  count(*) FILTER (list_sort(la) = list_sort(lb)) AS exact_sets, avg(CASE WHEN len(la) + len(lb) = 0 THEN 1.0::double ELSE len(list_intersect(list_distinct(la), list_distinct(lb)))::double / len(list_distinct(la || lb)) END) AS mean_jaccard FROM ab WHERE fin),
agr AS (SELECT comparable, agreements, raw_agreement, (raw_agreement - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) AS cohen_kappa, 'computed' AS kappa_status, exact_sets, exact_sets::double / comparable AS exact_set_agreement, mean_jaccard FROM kap),
res AS (SELECT a.* REPLACE (CASE WHEN a.doc_id % 4 = 0 AND len(fl) > 0 THEN 'artifact_provenance_mismatch' ELSE f END AS f, CASE WHEN a.doc_id % 4 = 0 AND len(fl) > 0 THEN replace(j, '"primary_failure":' || coalesce('"' || f || '"', 'null'), '"primary_failure":"artifact_provenance_mismatch"') ELSE j END AS j), a.doc_id % 4 = 0 AND len(fl) > 0 AND f IS DISTINCT FROM 'artifact_provenance_mismatch' AS changed FROM a JOIN dis USING (item_id) WHERE len(reasons) > 0)"""


def _rules(table: str) -> str:
    """The rules of decisions over a table of :func:`_said`, as (item_id, rule) rows."""
    known = "('false_completion', 'unsupported_claim', 'partial_completion_overclaim', 'tool_result_contradiction', 'artifact_provenance_mismatch', 'masking_pattern')"
    rules = {
        "decision_status": "st NOT IN ('final', 'abstain', 'ambiguous')", "failure_label": f"f NOT IN {known} OR len(list_filter(fl, lambda x: x NOT IN {known})) > 0", "failures_repeated": "len(list_distinct(fl)) < len(fl)", "checks_repeated": "n_checks > 1", "confidence_range": "confidence > 1",
        "evidence_kind": "has AND kind = 'odd'", "evidence_span": "has AND e1 < e0", "evidence_text": "has AND quote = ''", "evidence_without_failure": "has AND kind = 'supports_failure' AND ef IS NULL", "evidence_with_failure": "has AND kind <> 'supports_failure' AND ef IS NOT NULL",
        "open_with_labels": "st <> 'final' AND (r IS NOT NULL OR f IS NOT NULL OR len(fl) > 0 OR n_checks > 0)", "open_without_notes": "st <> 'final' AND notes IS NULL", "open_with_evidence": "st <> 'final' AND has AND (kind <> 'context' OR ef IS NOT NULL)",
        "final_without_verdict": "st = 'final' AND r IS NULL", "final_without_evidence": "st = 'final' AND NOT has", "final_without_checks": "st = 'final' AND n_checks = 0", "reliable_with_failures": "st = 'final' AND r AND (len(fl) > 0 OR f IS NOT NULL)", "reliable_evidence": "st = 'final' AND r AND has AND kind <> 'supports_reliability'",
        "unreliable_without_primary": "st = 'final' AND NOT r AND f IS NULL", "primary_not_listed": "st = 'final' AND NOT r AND f IS NOT NULL AND NOT list_contains(fl, f)", "failure_without_evidence": "st = 'final' AND NOT r AND len(list_filter(fl, lambda x: NOT coalesce(has AND kind = 'supports_failure' AND ef = x, false))) > 0",
        "evidence_of_other_failure": "st = 'final' AND NOT r AND has AND ef IS NOT NULL AND NOT list_contains(fl, ef)", "unreliable_evidence": "st = 'final' AND NOT r AND has AND kind <> 'supports_failure'",
        "evidence_beyond_lines": "has AND e1 > len(ls)", "quote_not_verbatim": "has AND e0 >= 1 AND e0 <= e1 AND e1 <= len(ls) AND NOT contains(array_to_string(ls[e0:e1], chr(10)), quote)",
    }
    return " UNION ALL ".join(f"SELECT item_id, '{name}' AS rule FROM {table} WHERE {test}" for name, test in rules.items())


# -- batch runs, on cases


def _cases(s, d):
    return views.cs(s, d).select("case_id", "doc_id", F.col("doc_id").alias("pos"), "trace", trace_sha(F.col("trace")).alias("trace_sha256"), "reliable", "primary_failure")


def _records(s, d):
    n = F.col("doc_id")
    return _cases(s, d).where("doc_id % 3 <> 0").select("case_id", F.when(n % 11 == 0, "failed").otherwise("succeeded").alias("status"), F.when(n % 40 == 1, "other").otherwise(F.col("trace_sha256")).alias("input_hash"), F.lit("run-1").alias("run_id"), ((n * 37 % 101) >= 50).alias("reliable"), (n * 37 % 101 / 100.0).alias("score"))


def resumed_run(s, d):
    """A run in three parts: the first hundred cases, all others, and once more with nothing left to do."""
    path, cases, manifest = new_table_path(s, "run"), materialize(_cases(s, d), "cases"), {"run_id": "run-1"}
    runs.resume_run(cases, path, manifest, batch.evaluate_lexical, max_cases=100)
    runs.resume_run(cases, path, manifest, batch.evaluate_lexical)
    records, _ = runs.resume_run(cases, path, manifest, batch.evaluate_lexical)
    return records.select("case_id", "pos", "batch", "status", "input_hash", "run_id")


def _gold(s, d):
    c = views.cs(s, d)
    ev = c.select("case_id", (F.col("doc_id") % 4 + 1).alias("line_start"), (F.col("doc_id") % 4 + F.col("doc_id") % 3).alias("line_end"))
    return batch.join_gold(_records(s, d), c.where("reliable is not null").select("case_id", "reliable", "primary_failure"), ev)


def _calls(s, d):
    views.register(s, d, "events")
    return s.sql(CALLS)


CALLS = """SELECT concat('run-', CAST(user_id AS string)) AS run_id, event_id AS index, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 100 END AS input_tokens, event_id % 50 AS output_tokens, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 100 + event_id % 50 END AS total_tokens,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '' ELSE concat('model-', CAST(event_id % 3 AS string)) END AS returned_model, CAST(event_id % 1000 AS double) AS latency_ms, event_type, value FROM events"""


def run_quality(s, d):
    """Runs of a few calls each, of which each call is a step."""
    c = _calls(s, d).withColumn("run_id", F.concat("run_id", F.lit("-"), (F.col("index") % 20).cast("string")))
    tool = F.when(F.col("index") % 97 == 0, "detect_strategic_masking").otherwise(F.concat(F.lit("tool-"), (F.col("index") % 7).cast("string")))
    steps = c.select("run_id", tool.alias("tool"), F.when(F.col("index") % 31 == 0, "failed").otherwise("ok").alias("status"))
    runs = c.groupBy("run_id").agg(F.max("index").alias("m")).select("run_id", (F.col("m") % 2 == 0).alias("lossy"), F.when(F.col("m") % 3 == 0, "legacy_text").otherwise("generic_json").alias("source_format"), (F.col("m") % 5 == 0).alias("reached_limit"))
    return batch.run_quality(steps, runs)


# -- JSON traces


def _json(s, d):
    """Traces of event objects, with aliases of keys, odd types and odd sequences at fixed places."""
    views.register(s, d, "events")
    return s.sql(f"WITH {JSON_ITEMS} SELECT concat('j', CAST(user_id AS string)) AS trace_id, concat('{{\"events\":[', array_join(transform(array_sort(collect_list(struct(event_id, item))), x -> x.item), ','), ']}}') AS raw FROM items GROUP BY user_id")


JSON_ITEMS = """items AS (SELECT user_id, event_id, concat('{"', CASE event_id % 3 WHEN 0 THEN 'event_id' WHEN 1 THEN 'eventId' ELSE 'id' END, '":',
  CASE event_id % 13 WHEN 5 THEN 'true' WHEN 6 THEN concat(CAST(event_id AS string), '.50') WHEN 7 THEN '"  "' WHEN 8 THEN '"dup"' ELSE concat('"e', CAST(event_id AS string), '"') END, ',"', CASE event_id % 2 WHEN 0 THEN 'type' ELSE 'kind' END, '":"',
  CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'tool-call' WHEN 'purchase' THEN 'function_call_output' WHEN 'error' THEN 'exception' ELSE CASE event_id % 2 WHEN 0 THEN 'file' ELSE 'mystery' END END,
  CASE WHEN event_type = 'view' THEN CASE event_id % 3 WHEN 0 THEN '","role":"agent' WHEN 1 THEN '","role":"user' ELSE '","role":"tool' END ELSE '' END, '","call_id":',
  CASE event_id % 17 WHEN 3 THEN '" ","tool_call_id":"real"' WHEN 4 THEN '123456789.5' WHEN 5 THEN '1e3' WHEN 6 THEN '25000000.50' WHEN 7 THEN 'false' ELSE concat('"c', CAST(event_id % 10 AS string), '"') END,
  ',"sequence":', CASE event_id % 6 WHEN 0 THEN '-1' WHEN 1 THEN concat('" ', CAST(event_id AS string), ' "') WHEN 2 THEN concat(CAST(event_id AS string), '.0') ELSE CAST(event_id AS string) END,
  CASE event_id % 7 WHEN 0 THEN ',"created_at":1700000000.50' WHEN 1 THEN ',"timestamp":true,"time":"never"' WHEN 2 THEN ',"time":"2024-01-02T03:04:05Z"' ELSE '' END,
  CASE WHEN event_type = 'click' THEN CASE event_id % 5 WHEN 0 THEN ',"args":{"n":25000000.5,"z":0.10,"a":[1e3,1.0]}' WHEN 1 THEN ',"input":" {\\\\"b\\\\": 1.0}"' WHEN 2 THEN ',"arguments":"{bad"' WHEN 3 THEN ',"parameters":2.50' ELSE '' END ELSE '' END,
  ',"status":"', CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'queued' WHEN 2 THEN 'ERROR' ELSE 'canceled' END, '","content":"text ', CAST(event_id AS string), '"}') AS item FROM events)"""


def nested_calls(s, d):
    """Messages with content blocks and nested calls, one trace per conversation."""
    views.register(s, d, "conversations")
    rows = s.sql("""SELECT concat('n', CAST(conv_id AS string)) AS trace_id, to_json(collect_list(item)) AS raw FROM (
        SELECT conv_id, named_struct('role', role, 'content', array(named_struct('type', CASE WHEN turn % 3 = 0 THEN 'tool_use' ELSE 'text' END, 'id', concat('b', turn), 'text', 'hello'), named_struct('type', 'text', 'id', 'z', 'text', 'more')), 'tool_calls', CASE WHEN turn % 2 = 0 THEN array(named_struct('id', concat('k', turn), 'function', named_struct('name', 'go', 'arguments', 'x'))) END) AS item FROM conversations) GROUP BY conv_id""")
    return generic.generic_events(rows)[0].groupBy("kind", "role").agg(F.count("*").alias("n"))


#: A trace per event: legacy text, JSON of all forms, and text that only looks like JSON.
ROUTED = """routed AS (SELECT concat('e', CAST(event_id AS string)) AS trace_id, event_id AS i, CASE event_id % 14
  WHEN 0 THEN 'User: hello' WHEN 1 THEN concat(' [{"role":"user","content":"n', CAST(event_id AS string), '"}]') WHEN 2 THEN '{"messages":[]}' WHEN 3 THEN '[{"type":"response.created"}]' WHEN 4 THEN '{"event":"response.done"}' WHEN 5 THEN '{"output":[]}' WHEN 6 THEN '{"output":"[x]"}' WHEN 7 THEN '{"response":{"output":[{}]}}'
  WHEN 8 THEN concat('{broken', chr(10), '[10:00] Tool call : x') WHEN 9 THEN concat('{broken', chr(10), '  user: x') WHEN 10 THEN '[{"type":"response.created"}' WHEN 11 THEN concat('[x', chr(10), 'STATE_CHANGE: y') WHEN 12 THEN '[1,{"type":"message"},{"output":[1]}]' ELSE '' END AS raw FROM events)"""


def routed(s, d):
    views.register(s, d, "events")
    return legacy.format_routing(s.sql(f"WITH {ROUTED} SELECT trace_id, raw FROM routed"))


def trace_diagnostics(s, d):
    """All that is said of the JSON traces: parsing, repeated ids, pairing, and secrets (every text that ends in 7 counts as one)."""
    events, parsed = generic.generic_events(_json(s, d))
    e = materialize(legacy.unique_event_ids(events), "events")
    pairs = pairing.pair_calls(e)
    secrets = e.groupBy("trace_id").agg(F.count_if(F.col("payload").like("text %7")).alias("n"))
    out = generic.trace_diagnostics(parsed, e, pairing.pairing_diagnostics(e, pairs), secrets)
    return out.groupBy("trace_id", "code", "severity", "category", "pos", "path", F.array_join("event_ids", ",").alias("event_ids")).agg(F.count("*").alias("n"))


def _held(s, d):
    """The events of users with their payloads as JSON values: texts, and for some objects whose keys aren't sorted."""
    e = views.ev(s, d)
    return materialize(e.withColumn("value", F.when(F.col("source_id") % 4 == 0, F.concat(F.lit('{"z":[{"b":1.50,"a":null}], "a":'), generic.quoted(F.col("payload")), F.lit("}"))).otherwise(generic.quoted(F.col("payload")))), "events")


def content_hash(s, d):
    e = _held(s, d)
    pairs = materialize(pairing.pair_calls(e), "pairs")
    facts = e.groupBy("trace_id").agg(F.lit("generic_json").alias("source_format"), (F.count("*") % 2 == 0).alias("lossy"))
    return generic.trace_hash(e, pairs, pairing.orphan_results(e, pairs), facts)


def trace_constraints(s, d):
    """Traces some of whose ids were lost or changed after pairing."""
    e = views.ev(s, d)
    pairs = materialize(pairing.pair_calls(e), "pairs")
    orphans = pairing.orphan_results(e, pairs)
    changed = e.withColumn("event_id", F.when(F.col("ord") % 9 == 0, "e1").otherwise(F.col("event_id"))).withColumn("kind", F.when(F.col("ord") % 8 == 3, "message").otherwise(F.col("kind")))
    return generic.check_trace_constraints(changed, pairs, orphans).groupBy("trace_id", "rule").agg(F.count("*").alias("n"))


RESPONSE_ITEMS = """messages AS (SELECT user_id, event_id, event_type, CASE event_type
  WHEN 'view' THEN concat('{"type":"response.output_item.added","item":{"type":"message","id":"i', CAST(event_id % 25 AS string), '","role":"assistant","content":"hi ', CAST(event_id AS string), '","status":"in_progress"}}')
  WHEN 'click' THEN concat('{"type":"response.output_item.done","item":{"type":"function_call","id":"i', CAST(event_id % 25 AS string), '","call_id":"c', CAST(event_id AS string), '","name":"go","arguments":"', CASE WHEN event_id % 4 = 0 THEN '{bad' ELSE '{}' END, '","status":"completed"}}')
  WHEN 'purchase' THEN concat('{"type":"response.function_call_arguments.done","item_id":"i', CAST(event_id % 25 AS string), '","call_id":"p', CAST(event_id AS string), '","name":"run","arguments":"[1]"}')
  WHEN 'error' THEN concat('{"type":"response.failed","response":{"error":"boom ', CAST(event_id AS string), '"}}')
  ELSE '{"type":"response.in_progress","response":{"id":"resp","status":"in_progress"}}' END AS item FROM events)"""


def _responses(s, d):
    """Response streams, one per user: added, finished, failed and other messages."""
    views.register(s, d, "events")
    return s.sql(f"WITH {RESPONSE_ITEMS} SELECT concat('s', CAST(user_id AS string)) AS trace_id, concat('[', array_join(transform(array_sort(collect_list(struct(event_id, item))), x -> x.item), ','), ']') AS raw FROM messages GROUP BY user_id")


_DONE = "done AS (SELECT DISTINCT user_id, event_id % 25 AS k FROM events WHERE event_type = 'click'), m AS (SELECT e.*, d.k IS NOT NULL AS done FROM events e LEFT JOIN done d ON d.user_id = e.user_id AND d.k = e.event_id % 25)"


def response_fold(s, d):
    """Response stream messages from events: added and finished items, and deltas of unfinished ones."""
    views.register(s, d, "events")
    m = s.sql("""SELECT concat('r', CAST(user_id % 50 AS string)) AS trace_id, event_id AS pos, to_json(named_struct('type', CASE event_type WHEN 'view' THEN 'response.output_item.added' WHEN 'click' THEN 'response.output_item.done' ELSE 'response.output_text.delta' END,
        'item_id', CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE concat('i', event_id % 40) END, 'item', CASE WHEN event_type IN ('view', 'click') THEN named_struct('id', concat('i', event_id % 40), 'n', event_id) END)) AS item FROM events""")
    items, left = generic.fold_response_stream(m)
    a = items.groupBy("trace_id").agg(F.count("*").alias("n_items"))
    return a.join(left.groupBy("trace_id").agg(F.count("*").alias("n_left")), "trace_id", "full_outer").fillna(0)


# -- batch twins of streams


def admission(s, d):
    views.register(s, d, "events")
    r = s.sql("SELECT concat('c', CAST(user_id % 20 AS string)) AS client_id, ts, event_id AS request_id FROM events")
    return jobs.admit_batch(r, limit=3, window=3600).select("client_id", "request_id", "allowed", "remaining", "retry_after")


def progress(s, d):
    """Runs of a few users each: steps, errors, completions, some with what comes behind an error, some with neither."""
    views.register(s, d, "events")
    m = s.sql("""SELECT concat('run-', CAST(user_id AS string), '-', CAST(event_id % 9 AS string)) AS run_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'complete' WHEN 'error' THEN 'error' WHEN 'view' THEN 'agent_started' ELSE 'agent_step' END AS type, named_struct('tool', event_type) AS step,
        CASE WHEN event_type = 'signup' THEN concat('r', CAST(event_id AS string)) END AS report_json, CASE WHEN event_type = 'error' THEN concat('x', CAST(event_id AS string)) END AS error FROM events""")
    return jobs.fold_progress(m, ended=True)


QUERIES = {
    "path_admission": lambda s, d: views.ac(s, d).select("episode_id", "step", episodes.valid_path(F.col("path")).alias("valid")),
    "action_violations": lambda s, d: episodes.check_actions(views.ac(s, d).withColumn("content", F.when(F.col("source_id") % 13 != 0, F.col("content")))),
    "effective_actions": lambda s, d: _eff(s, d).select("episode_id", "step", "type", "end_reason"),
    "revisions": lambda s, d: episodes.revisions(_eff(s, d)).select("episode_id", "step", "admitted", "revision"),
    "final_files": lambda s, d: episodes.file_state(_eff(s, d), views.task_tables(s)[0]),
    "read_outcomes": lambda s, d: episodes.read_outcomes(_eff(s, d), views.task_tables(s)[0]),
    "test_freshness": lambda s, d: episodes.test_runs(_eff(s, d), *views.task_tables(s)[:2]),
    "reward": _reward,
    "scoreboard": scoreboard,
    "step_results": step_results,
    "episode_events": episode_events,
    "episode_pairs": episode_pairs,
    "blind_ids": lambda s, d: annotation.blind_ids(views.cs(s, d), DATASET).select("case_id", "item_id"),
    "packet_order": lambda s, d: _packets(s, d, _items(s, d))[1].select("annotator_id", "pos", "item_id", "trace_sha256"),
    "packet_lines": lambda s, d: annotation.packet_lines(annotation.blind_ids(views.cs(s, d), DATASET)).groupBy("item_id").agg(F.count("*").alias("n_lines"), F.max("line_number").alias("last"), F.sum(F.char_length("text")).alias("n_chars")),
    "packet_hashes": packet_hashes,
    "packet_violations": packet_violations,
    "blind_texts": lambda s, d: _items(s, d).select("case_id", F.element_at("lines", -1)["text"].alias("last_line"), F.size("swaps").cast("long").alias("n_identifiers")),
    "agreement": agreement,
    "disagreements": disagreements,
    "adjudication_violations": adjudication_violations,
    "frozen_labels": frozen,
    "response_violations": response_violations,
    "freeze_manifest": freeze_manifest,
    "pending_cases": lambda s, d: batch.pending_cases(_cases(s, d), _records(s, d), retry_failed=True).select("case_id", "pos"),
    "resumed_run": resumed_run,
    "record_violations": lambda s, d: batch.check_records(_records(s, d), _cases(s, d), {"run_id": "run-1"}),
    "lexical_evaluator": lambda s, d: batch.evaluate_lexical(_cases(s, d)).select("case_id", "reliable", "reliability_score"),
    "gold_join": lambda s, d: _gold(s, d).select("case_id", "gold_reliable", "missing_label", F.array_join(F.col("gold_lines").cast("array<string>"), ",").alias("gold_lines")),
    "run_summary": lambda s, d: batch.run_summary(_cases(s, d), _records(s, d), _gold(s, d).where("not missing_label")),
    "run_manifest": lambda s, d: batch.run_manifest(_cases(s, d), {"evaluator": "lexical", "prompt": "p1"}),
    "judge_requests": lambda s, d: batch.judge_requests(_cases(s, d)).select("case_id", F.sha2("request", 256).alias("request_sha256"), F.length("request").cast("long").alias("n_chars")),
    "telemetry": lambda s, d: batch.run_telemetry(_calls(s, d)),
    "monitoring_tier": run_quality,
    "json_routing": routed,
    "generic_events": lambda s, d: generic.generic_events(_json(s, d))[0].select("trace_id", "ord", "event_id", "sequence", "kind", "ts_raw", F.unix_micros("ts").alias("ts_micros"), "call_id", "status", "role", "tool_name", "payload", "value", "path", "raw_type"),
    "response_events": lambda s, d: generic.response_events(_responses(s, d))[0].select("trace_id", "ord", "kind", "status", "call_id", "payload"),
    "response_diagnostics": lambda s, d: generic.response_events(_responses(s, d))[1].groupBy("trace_id", "code").agg(F.count("*").alias("n")),
    "generic_diagnostics": lambda s, d: generic.generic_events(_json(s, d))[1].groupBy("trace_id", "code", "pos", "path").agg(F.count("*").alias("n")),
    "trace_diagnostics": trace_diagnostics,
    "nested_calls": nested_calls,
    "response_fold": response_fold,
    "trace_constraints": trace_constraints,
    "trace_content_hash": content_hash,
    "trace_summary": lambda s, d: generic.trace_summary(*generic.generic_events(_json(s, d))),
    "admission": admission,
    "progress_fold": progress,
}

_GEN = """g AS (SELECT 'j' || user_id AS trace_id, event_id AS i, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
gk AS (SELECT *, event_type = 'view' AND i % 3 = 2 AS twice, CASE WHEN event_type = 'view' THEN CASE WHEN i % 3 = 2 THEN 'tool_result' ELSE 'message' END WHEN event_type = 'click' THEN 'tool_call' WHEN event_type = 'purchase' THEN 'tool_result' WHEN event_type = 'error' THEN 'error' WHEN i % 2 = 0 THEN 'artifact' END AS kind FROM g),
gn AS (SELECT *, '$.events[' || pos || ']' AS path, count(kind) OVER (PARTITION BY trace_id ORDER BY pos) - CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS ord, CASE i % 13 WHEN 5 THEN NULL WHEN 6 THEN i || '.5' WHEN 7 THEN NULL WHEN 8 THEN 'dup' ELSE 'e' || i END AS own_id FROM gk),
k AS (SELECT *, coalesce(own_id, 'generic:' || ord) AS event_id, CASE i % 17 WHEN 4 THEN '123456789.5' WHEN 5 THEN '1000' WHEN 6 THEN '25000000.5' WHEN 3 THEN CASE WHEN kind = 'tool_call' AND i % 3 = 2 THEN own_id END WHEN 7 THEN CASE WHEN kind = 'tool_call' AND i % 3 = 2 THEN own_id END ELSE 'c' || (i % 10) END AS call_id,
  CASE WHEN kind = 'error' OR i % 4 = 2 THEN 'failed' ELSE CASE i % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'pending' ELSE 'cancelled' END END AS status FROM gn WHERE kind IS NOT NULL),
gd AS (SELECT trace_id, 'UNSUPPORTED_EVENT' AS code, pos, path, 1 AS n FROM gn WHERE kind IS NULL UNION ALL SELECT trace_id, 'INVALID_SEQUENCE', pos, path, CASE WHEN twice THEN 2 ELSE 1 END FROM gn WHERE i % 6 = 0
  UNION ALL SELECT trace_id, 'INVALID_TIMESTAMP', pos, path, CASE WHEN twice THEN 2 ELSE 1 END FROM gn WHERE i % 7 = 1 UNION ALL SELECT trace_id, 'MALFORMED_TOOL_ARGUMENTS', pos, path, 1 FROM gn WHERE kind = 'tool_call' AND i % 5 = 2)"""
_JOB = "records AS (SELECT case_id, doc_id, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'succeeded' END AS status, (doc_id * 37 % 101) >= 50 AS rel FROM cs WHERE doc_id % 3 <> 0)"
_GOLD = f"{views.CS}, {_JOB}, gold AS (SELECT r.case_id, c.reliable AS gold_reliable, c.reliable IS NULL AS missing_label, r.rel, CASE WHEN c.doc_id % 4 + c.doc_id % 3 >= c.doc_id % 4 + 1 THEN array_to_string(generate_series(c.doc_id % 4 + 1, c.doc_id % 4 + c.doc_id % 3), ',') ELSE '' END AS gold_lines FROM records r JOIN cs c USING (case_id) WHERE r.status = 'succeeded')"

_TREE = "b AS (SELECT substr(h, 1, 4) AS bucket, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM lines GROUP BY 1), tree AS (SELECT sum(n)::bigint AS n, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS sha256 FROM b)"

_STEPS = f"""{EFF}, res AS (SELECT e.episode_id, e.task_id, e.step, e.type, e.path, CASE e.type WHEN 'read_file' THEN 'read_' || CASE WHEN e.path = '../x' THEN 'invalid' WHEN k.content IS NULL THEN 'not_found' ELSE 'found' END WHEN 'write_file' THEN CASE WHEN e.admitted THEN 'written' ELSE 'write_invalid' END
  WHEN 'run_tests' THEN CASE WHEN t.passed THEN 'tests_passed' ELSE 'tests_failed' END ELSE 'submitted' END AS code FROM rev e LEFT JOIN state k ON k.episode_id = e.episode_id AND k.step = e.step AND k.path = e.path AND e.type = 'read_file' LEFT JOIN tests t ON t.episode_id = e.episode_id AND t.step = e.step),
  done AS (SELECT *, code IN ('read_found', 'written', 'tests_passed', 'submitted') AS ok FROM res)"""

ORACLE_SQL = {
    "json_routing": f"""WITH {ROUTED}, t AS (SELECT *, trim(raw, ' ' || chr(10)) AS r FROM routed), v AS (SELECT *, starts_with(r, '{{') OR starts_with(r, '[') AS looks, json_valid(r) AS ok, regexp_matches(raw, '(?im)^(\\[[^\\]]+\\]\\s*)?(user|agent|assistant|system|tool(\\s+(call|result))?|artifact|error|state(_change)?)\\s*:') AS headed FROM t),
        items AS (SELECT trace_id, unnest(CASE WHEN starts_with(r, '[') THEN from_json(r, '["JSON"]') ELSE [r::json] END) AS x FROM v WHERE looks AND ok), resp AS (SELECT DISTINCT trace_id FROM items WHERE coalesce(coalesce(x->>'$.type', x->>'$.event') LIKE 'response.%', false) OR json_type(x, '$.output') = 'ARRAY' OR json_type(x, '$.response.output') = 'ARRAY')
        SELECT trace_id, CASE WHEN NOT looks THEN 'legacy_text' WHEN NOT ok THEN CASE WHEN headed THEN 'legacy_text' ELSE 'generic_json' END WHEN resp.trace_id IS NOT NULL THEN 'responses' ELSE 'generic_json' END AS format, looks AND NOT ok AND NOT headed AS invalid FROM v LEFT JOIN resp USING (trace_id)""",
    "packet_hashes": f"""WITH {AB}, placed AS (SELECT annotator_id, row_number() OVER (PARTITION BY annotator_id ORDER BY sha256(encode('seed') || '\\x00'::blob || encode(annotator_id) || '\\x00'::blob || encode(item_id)), item_id) - 1 AS pos, sha256('{{"item_id":"' || item_id || '","lines":[' || array_to_string(list_transform(ls, lambda x, i: '{{"line_number":' || i || ',"text":' || to_json(x)::varchar || '}}'), ',') || '],"trace_sha256":"' || sha || '"}}') AS digest
          FROM items, (SELECT unnest(['annotator-a', 'annotator-b']) AS annotator_id)), l AS (SELECT annotator_id, sha256(pos || '|' || digest) AS h FROM placed), bu AS (SELECT annotator_id, substr(h, 1, 4) AS bucket, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM l GROUP BY 1, 2), tr AS (SELECT annotator_id, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS tree FROM bu GROUP BY 1),
          pk AS (SELECT *, 'packet-' || substr(sha256(array_to_string(['1.0.0', '{DATASET}', 'v1', annotator_id, '2026-01-01T00:00:00Z', 'seed'], chr(0))), 1, 24) AS packet_id FROM tr)
        SELECT annotator_id, packet_id, sha256(array_to_string(['1.0.0', packet_id, 'set-1', '{DATASET}', 'v1', annotator_id, '2026-01-01T00:00:00Z', tree], chr(0))) AS packet_sha256 FROM pk""",
    "freeze_manifest": f"""WITH {AB}, fr AS (SELECT a.*, true AS agreed FROM a JOIN dis USING (item_id) WHERE len(reasons) = 0 UNION ALL BY NAME SELECT * EXCLUDE (changed), false AS agreed FROM res), k AS (SELECT fr.*, replace(fr.quote, ls[-1], string_split(regexp_replace(trace, '\\r\\n?', chr(10), 'g'), chr(10))[-1]) AS said FROM fr JOIN tc USING (doc_id) WHERE st = 'final' AND r IS NOT NULL),
        l AS (SELECT agreed, sha256('{{"case_id":"' || case_id || '","failures":[' || coalesce(array_to_string(list_transform(list_sort(fl), lambda x: '"' || x || '"'), ','), '') || '],"gold_evidence":[' || CASE WHEN has THEN '{{"failure":' || coalesce('"' || ef || '"', 'null') || ',"kind":"' || kind || '","line_end":' || e1 || ',"line_start":' || e0 || ',"quote":"' || said || '","rationale":"seen there"}}' ELSE '' END || '],"primary_failure":' || coalesce('"' || f || '"', 'null') || ',"reliable":' || r
          || ',"required_checks":[' || CASE n_checks WHEN 0 THEN '' WHEN 1 THEN '"claim_support"' ELSE '"claim_support","claim_support"' END || '],"review_status":"frozen"}}') AS h FROM k), bu AS (SELECT substr(h, 1, 4) AS bucket, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM l GROUP BY 1)
        SELECT count(*) AS items, count(*) FILTER (agreed) AS agreed, count(*) FILTER (NOT agreed) AS adjudicated, (SELECT sha256(string_agg(h, chr(10) ORDER BY bucket)) FROM bu) AS label_sha256, 'accepted_without_time,adjudication' AS broken FROM l""",
    "step_results": f"WITH {_STEPS} SELECT episode_id, step, type, ok, code FROM done",
    "episode_events": f"""WITH {_STEPS} SELECT episode_id AS trace_id, -1::bigint AS ord, 'request' AS event_id, 'message' AS kind, NULL AS call_id, NULL AS parent_id, 'unknown' AS status, 'recorded' AS provenance, 'user' AS role, instruction AS payload FROM (SELECT DISTINCT episode_id, task_id FROM done) JOIN tasks USING (task_id)
        UNION ALL SELECT episode_id, step * 2, 'call-' || step, 'tool_call', 'step-' || step, 'request', 'pending', 'recorded', NULL, concat_ws(' ', type, path) FROM done WHERE type <> 'submit' UNION ALL SELECT episode_id, step * 2 + 1, 'result-' || step, 'tool_result', 'step-' || step, NULL, CASE WHEN ok THEN 'succeeded' ELSE 'failed' END, 'verified', NULL, code FROM done WHERE type <> 'submit'
        UNION ALL SELECT episode_id, step * 2 + 1, 'report', 'message', NULL, 'request', 'unknown', 'declared', 'assistant', 's' FROM done WHERE type = 'submit'""",
    "episode_pairs": f"WITH {_STEPS} SELECT CASE WHEN ok THEN 'succeeded' ELSE 'failed' END AS status, 'recorded' AS provenance, count(*) AS n FROM done WHERE type <> 'submit' GROUP BY 1",
    "judge_requests": f"""WITH {views.CS}, q AS (SELECT case_id, replace(replace(replace('{{"trace":' || to_json(array_to_string(list_transform(string_split(trace, chr(10)), lambda x, i: i || ': ' || x), chr(10)))::varchar || '}}', '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS r FROM cs) SELECT case_id, sha256(r) AS request_sha256, length(r) AS n_chars FROM q""",
    "lexical_evaluator": f"SELECT trace_id AS case_id, reliable, reliability_score FROM ({TRACE_SQL['explanations'].replace(views.TX_DUCK, views.CS + ', tx AS (SELECT case_id AS trace_id, trace AS raw FROM cs)')}) WHERE mode = 'research'",
    "run_summary": f"""WITH {_GOLD}, g AS (SELECT count(*) FILTER (gold_reliable AND rel) AS tp, count(*) FILTER (gold_reliable AND NOT rel) AS fn, count(*) FILTER (NOT gold_reliable AND rel) AS fp, count(*) FILTER (NOT gold_reliable AND NOT rel) AS tn FROM gold WHERE NOT missing_label),
        n AS (SELECT count(*) AS n_records, count(*) FILTER (status = 'succeeded') AS n_succeeded, count(*) FILTER (status = 'failed') AS n_failed FROM records)
        SELECT n.*, (SELECT count(*) FROM cs) AS n_cases, 'partial' AS status, (tp + tn)::double / (tp + tn + fp + fn) AS accuracy, (tp::double / (tp + fn) + tn::double / (tn + fp)) / 2 AS balanced_accuracy, (2.0::double * tp / (2 * tp + fp + fn) + 2.0::double * tn / (2 * tn + fp + fn)) / 2 AS macro_f1 FROM n, g""",
    "run_manifest": f"""WITH {views.CS}, lines AS (SELECT sha256(concat_ws('|', doc_id, case_id, sha256(regexp_replace(trace, '\\r\\n?', chr(10), 'g')))) AS h FROM cs), {_TREE}
        SELECT n AS n_cases, sha256 AS dataset_sha256, sha256('lexical') AS evaluator_sha256, sha256('p1') AS prompt_sha256, 'run-' || substr(sha256(concat_ws('|', sha256, sha256('lexical'), sha256('p1'))), 1, 16) AS run_id FROM tree""",
    "path_admission": f"WITH {views.AC} SELECT episode_id, step, coalesce(path IN ('a.txt', 'out.txt', 'none.txt', 'cfg.json'), false) AS valid FROM ac",
    "action_violations": f"WITH {views.AC} SELECT episode_id, step, 'content' AS rule FROM ac WHERE type = 'write_file' AND source_id % 13 = 0",
    "effective_actions": f"WITH {EFF} SELECT episode_id, step, type, CASE WHEN bool_or(type = 'submit') OVER (PARTITION BY episode_id) THEN 'submitted' WHEN count(*) OVER (PARTITION BY episode_id) >= max_steps THEN 'max_steps' ELSE 'open' END AS end_reason FROM eff",
    "revisions": f"WITH {EFF} SELECT episode_id, step, coalesce(admitted, false) AS admitted, revision FROM rev",
    "final_files": f"WITH {EFF} SELECT * FROM final",
    "read_outcomes": f"WITH {EFF} SELECT e.episode_id, e.step, e.path, CASE WHEN e.path = '../x' THEN 'invalid' WHEN state.content IS NULL THEN 'not_found' ELSE 'found' END AS outcome, CASE WHEN e.path <> '../x' THEN state.content END AS content FROM eff e LEFT JOIN state ON state.episode_id = e.episode_id AND state.step = e.step AND state.path = e.path WHERE e.type = 'read_file'",
    "test_freshness": f"WITH {EFF} SELECT episode_id, step, passed, revision, maybe AS fresh FROM tests",
    "reward": f"WITH {EFF} SELECT * EXCLUDE (policy_id) FROM reward",
    "scoreboard": f"WITH {EFF} SELECT task_id, policy_id, count(*) AS episodes, avg(steps) AS mean_steps, round(avg(reward), 4) AS mean_reward FROM reward GROUP BY 1, 2",
    "blind_ids": f"WITH {views.CS} SELECT case_id, 'item-' || substr(sha256(encode('1.0.0') || '\\x00'::blob || encode('{DATASET}') || '\\x00'::blob || encode(case_id) || '\\x00'::blob || encode(sha256(regexp_replace(trace, '\\r\\n?', chr(10), 'g')))), 1, 24) AS item_id FROM cs",
    "agreement": f"WITH {AB} SELECT agr.*, (SELECT count(*) FROM ab) AS items, (SELECT count(*) FROM dis WHERE len(reasons) > 0) AS disagreements FROM agr",
    "disagreements": f"WITH {AB} SELECT item_id, array_to_string(reasons, ',') AS reasons FROM dis WHERE len(reasons) > 0",
    "frozen_labels": f"""WITH {AB}, fr AS (SELECT a.*, 'independent_agreement' AS how, NULL AS who FROM a JOIN dis USING (item_id) WHERE len(reasons) = 0 UNION ALL BY NAME SELECT * EXCLUDE (changed), 'adjudicated' AS how, 'adjudicator-c' AS who FROM res)
        SELECT fr.case_id, r AS reliable, f AS primary_failure, array_to_string(list_sort(fl), ',') AS failures, CASE WHEN has THEN replace(fr.quote, ls[-1], string_split(regexp_replace(trace, '\r\n?', chr(10), 'g'), chr(10))[-1]) END AS quote, CASE WHEN has THEN e0 END AS line_start, has::bigint AS n_evidence, 'frozen' AS review_status, how AS resolution, sha256(j) AS decision_sha256, who AS adjudicator_id FROM fr JOIN tc USING (doc_id) WHERE st = 'final' AND r IS NOT NULL""",
    "packet_order": f"""WITH {AB} SELECT annotator_id, row_number() OVER (PARTITION BY annotator_id ORDER BY sha256(encode('seed') || '\x00'::blob || encode(annotator_id) || '\x00'::blob || encode(item_id)), item_id) - 1 AS pos, item_id, sha AS trace_sha256 FROM items, (SELECT unnest(['annotator-a', 'annotator-b']) AS annotator_id)""",
    "packet_lines": f"WITH {views.CS}, t AS (SELECT {_ID} AS item_id, string_split(regexp_replace(trace, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM cs) SELECT item_id, sum(len(ls))::bigint AS n_lines, max(len(ls)) AS last, sum(len(array_to_string(ls, '')))::bigint AS n_chars FROM t GROUP BY item_id",
    "blind_texts": f"WITH {AB} SELECT case_id, ls[-1] AS last_line, 3 + (style_pair_id IS NOT NULL)::bigint + (counterfactual_pair_id IS NOT NULL)::bigint AS n_identifiers FROM items",
    "packet_violations": f"""WITH {AB}, n AS (SELECT *, ('0x' || substr(item_id, 6, 6))::bigint % 11 AS k FROM items), every AS (SELECT 'missing' AS rule, item_id FROM n WHERE k IN (0, 3) UNION ALL SELECT 'unexpected', item_id || 'x' FROM n WHERE k = 3 UNION ALL SELECT 'line_numbers', item_id FROM n WHERE k = 2 UNION ALL SELECT 'trace_hash', item_id FROM n WHERE k = 1 UNION ALL SELECT 'item_differs', item_id FROM n WHERE k IN (1, 2)
        UNION ALL SELECT 'packet_sha256', NULL) SELECT 'annotator-b' AS annotator_id, item_id, rule FROM every""",
    "response_violations": f"""WITH {AB}, own AS (SELECT * FROM a WHERE v <> 13), twice AS (SELECT * FROM own UNION ALL SELECT * FROM own WHERE v = 14), ra AS ({_rules("twice")}), rb AS ({_rules("b")})
        SELECT 'annotator-b' AS annotator_id, NULL AS item_id, unnest(['packet_sha256', 'codebook_version']) AS rule UNION ALL SELECT 'annotator-a', item_id, 'missing' FROM a WHERE v = 13 UNION ALL SELECT 'annotator-a', item_id, 'repeated' FROM own WHERE v = 14
        UNION ALL SELECT 'annotator-a', item_id, rule FROM ra WHERE rule NOT IN ('evidence_beyond_lines', 'quote_not_verbatim') UNION ALL SELECT DISTINCT 'annotator-a', item_id, rule FROM ra WHERE rule IN ('evidence_beyond_lines', 'quote_not_verbatim') UNION ALL SELECT 'annotator-b', item_id, rule FROM rb""",
    "adjudication_violations": f"""WITH {AB}, own AS (SELECT * FROM res WHERE doc_id % 8 <> 1), rr AS ({_rules("own")}) SELECT 'adjudicator-c' AS adjudicator_id, NULL AS item_id, 'comparison_sha256' AS rule UNION ALL SELECT 'adjudicator-c', item_id, rule FROM rr
        UNION ALL SELECT 'adjudicator-c', item_id, 'missing' FROM res WHERE doc_id % 8 = 1 UNION ALL SELECT 'adjudicator-c', item_id, 'not_final' FROM own WHERE st <> 'final' UNION ALL SELECT 'adjudicator-c', item_id, 'rationale' FROM own WHERE doc_id % 9 = 0 UNION ALL SELECT 'adjudicator-c', item_id, 'differs_from_a' FROM own WHERE changed AND doc_id % 2 = 0""",
    "pending_cases": f"WITH {views.CS}, {_JOB} SELECT case_id, doc_id AS pos FROM cs ANTI JOIN (FROM records WHERE status = 'succeeded') r USING (case_id)",
    "resumed_run": f"WITH {views.CS} SELECT case_id, doc_id AS pos, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 100 THEN 0 ELSE 1 END::bigint AS batch, 'succeeded' AS status, sha256(regexp_replace(trace, '\\r\\n?', chr(10), 'g')) AS input_hash, 'run-1' AS run_id FROM cs",
    "record_violations": f"WITH {views.CS} SELECT case_id, 'input_hash' AS rule FROM cs WHERE doc_id % 3 <> 0 AND doc_id % 40 = 1",
    "gold_join": f"WITH {_GOLD} SELECT case_id, gold_reliable, missing_label, gold_lines FROM gold",
    "telemetry": f"WITH c AS ({CALLS}) SELECT run_id, count(*) AS n_calls, coalesce(sum(input_tokens), 0)::bigint AS input_tokens, sum(output_tokens)::bigint AS output_tokens, coalesce(sum(total_tokens), 0)::bigint AS total_tokens, count(input_tokens) = count(*) AS complete, arg_max(returned_model, index) FILTER (returned_model <> '') AS returned_model, sum(latency_ms) AS model_ms FROM c GROUP BY run_id",
    "monitoring_tier": f"""WITH c AS ({CALLS}), t AS (SELECT run_id || '-' || (index % 20) AS run_id, count(DISTINCT CASE WHEN index % 97 = 0 THEN -1 ELSE index % 7 END) AS n, bool_or(index % 97 = 0) AS masking, bool_or(index % 31 = 0) AS failed, max(index) AS m FROM c GROUP BY 1),
        r AS (SELECT *, list_filter([CASE WHEN m % 2 = 0 THEN 'lossy_trace' END, CASE WHEN m % 3 = 0 THEN 'legacy_declared_fallback' END, CASE WHEN failed THEN 'diagnostic_tool_failure' END, CASE WHEN m % 5 = 0 THEN 'step_limit_reached' END], lambda x: x IS NOT NULL) AS reasons FROM t)
        SELECT run_id, len(reasons) > 0 AS degraded, coalesce(array_to_string(reasons, ','), '') AS reasons, CASE WHEN masking OR n >= 5 THEN 'deep' WHEN n >= 3 THEN 'standard' ELSE 'light' END AS tier FROM r""",
    "generic_events": f"""WITH {_GEN}
        SELECT trace_id, ord, event_id, CASE WHEN i % 6 = 0 THEN ord ELSE i END AS sequence, kind, CASE i % 7 WHEN 0 THEN '1700000000.5' WHEN 2 THEN '2024-01-02T03:04:05Z' END AS ts_raw, CASE i % 7 WHEN 0 THEN 1700000000500000 WHEN 2 THEN epoch_us(TIMESTAMP '2024-01-02 03:04:05') END AS ts_micros,
        call_id, status, CASE WHEN kind = 'message' THEN CASE i % 3 WHEN 0 THEN 'assistant' ELSE 'user' END END AS role, CASE WHEN kind = 'tool_call' THEN 'tool' END AS tool_name,
        CASE kind WHEN 'tool_call' THEN CASE i % 5 WHEN 0 THEN '{{"n":25000000.5,"z":0.1,"a":[1000,1]}}' WHEN 1 THEN '{{"b":1}}' WHEN 2 THEN '{{bad' WHEN 3 THEN '2.5' END WHEN 'error' THEN 'Unknown trace error' ELSE 'text ' || i END AS payload,
        CASE kind WHEN 'tool_call' THEN CASE i % 5 WHEN 0 THEN '{{"n":25000000.5,"z":0.1,"a":[1000,1]}}' WHEN 1 THEN '{{"b":1}}' WHEN 2 THEN '"{{bad"' WHEN 3 THEN '2.5' ELSE 'null' END WHEN 'error' THEN NULL ELSE '"text ' || i || '"' END AS value,
        path, CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'function_call_output' WHEN 'error' THEN 'exception' ELSE 'file' END AS raw_type FROM k""",
    "trace_diagnostics": f"""WITH {_GEN}, src AS (SELECT * EXCLUDE (event_id), CASE WHEN nth > 1 THEN event_id || '#' || nth ELSE event_id END AS event_id, event_id AS first_id, 'recorded' AS provenance, NULL AS parent_id FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, event_id ORDER BY ord) AS nth FROM k)), {PAIRS},
        pd AS (SELECT trace_id, 'UNMATCHED_TOOL_CALL' AS code, [call_event_id] AS ids FROM pairs WHERE result_event_id IS NULL UNION ALL SELECT trace_id, 'MISSING_CALL_ID', [event_id] FROM c WHERE call_id IS NULL UNION ALL SELECT trace_id, 'DUPLICATE_CALL_ID', list(event_id ORDER BY ord) FROM c WHERE call_id IS NOT NULL GROUP BY trace_id, call_id HAVING count(*) > 1
          UNION ALL SELECT trace_id, CASE WHEN call_id IS NULL THEN 'MISSING_CALL_ID' ELSE 'ORPHAN_TOOL_RESULT' END, [event_id] FROM r ANTI JOIN pairs p ON p.trace_id = r.trace_id AND p.result_event_id = r.event_id),
        every AS (SELECT trace_id, code, 'warning' AS severity, CASE WHEN code LIKE 'INVALID%' THEN 'validation' ELSE 'parsing' END AS category, pos, path, NULL AS event_ids, n FROM gd UNION ALL SELECT trace_id, 'DUPLICATE_EVENT_ID', 'warning', 'validation', pos, path, first_id || ',' || event_id, 1 FROM src WHERE event_id <> first_id
          UNION ALL SELECT pd.trace_id, code, 'warning', 'pairing', pos, path, array_to_string(ids, ','), 1 FROM pd JOIN src ON src.trace_id = pd.trace_id AND src.event_id = ids[1]
          UNION ALL SELECT trace_id, 'REDACTED_SECRET', 'info', 'redaction', NULL, NULL, NULL, 1 FROM k WHERE kind NOT IN ('tool_call', 'error') AND i % 10 = 7 GROUP BY trace_id)
        SELECT trace_id, code, severity, category, pos, path, event_ids, sum(n)::bigint AS n FROM every GROUP BY ALL""",
    "trace_constraints": f"""WITH {SRC_EV}, {PAIRS}, x AS (SELECT trace_id, CASE WHEN ord % 9 = 0 THEN 'e1' ELSE event_id END AS event_id, CASE WHEN ord % 8 = 3 THEN 'message' ELSE kind END AS kind FROM src),
        refs AS (SELECT trace_id, 'call_event_id_kind' AS rule, 'tool_call' AS kind, call_event_id AS event_id FROM pairs UNION ALL SELECT trace_id, 'result_event_id_kind', 'tool_result', result_event_id FROM pairs WHERE result_event_id IS NOT NULL
          UNION ALL SELECT r.trace_id, 'orphan_event_id_kind', 'tool_result', r.event_id FROM r ANTI JOIN pairs p ON p.trace_id = r.trace_id AND p.result_event_id = r.event_id),
        bad AS (SELECT trace_id, 'event_id_repeated' AS rule FROM x GROUP BY trace_id, event_id HAVING count(*) > 1 UNION ALL SELECT trace_id, rule FROM refs ANTI JOIN x USING (trace_id, event_id, kind)) SELECT trace_id, rule, count(*) AS n FROM bad GROUP BY ALL""",
    "trace_content_hash": f"""WITH {SRC_EV}, {PAIRS}, q AS (SELECT *, '"' || payload || '"' AS p, CASE WHEN source_id % 4 = 0 THEN '{{"a":"' || payload || '","z":[{{"a":null,"b":1.5}}]}}' ELSE '"' || payload || '"' END AS v FROM src),
        e AS (SELECT trace_id, string_agg('{{' || concat_ws(',', CASE WHEN kind = 'tool_call' THEN '"arguments":' || v END, '"call_id":"' || call_id || '"', CASE WHEN kind = 'message' THEN '"content":' || v END, CASE WHEN kind = 'artifact' THEN '"data":' || v END, CASE WHEN kind = 'error' THEN '"error":{{"details":' || v || ',"message":' || p || '}}' END,
          '"event_id":"' || event_id || '"', '"parent_id":"' || parent_id || '"', '"provenance":"' || provenance || '"', CASE WHEN kind = 'tool_result' THEN '"result":' || v END, '"role":"' || role || '"', '"sequence":' || ord, '"source":{{"format":"generic_json","index":' || ord || '}}', '"status":"' || status || '"', '"tool_name":"' || tool_name || '"', '"type":"' || kind || '"') || '}}', ',' ORDER BY ord) AS j, count(*) AS n FROM q GROUP BY trace_id),
        p AS (SELECT pairs.trace_id, string_agg('{{"call_event_id":"' || call_event_id || '","call_id":' || coalesce('"' || pairs.call_id || '"', 'null') || ',"pair_id":"' || pair_id || '","provenance":"' || pairs.provenance || '","result_event_id":' || coalesce('"' || result_event_id || '"', 'null') || ',"status":"' || pairs.status || '"}}', ',' ORDER BY ord) AS j FROM pairs JOIN src ON src.trace_id = pairs.trace_id AND src.event_id = call_event_id GROUP BY 1),
        o AS (SELECT r.trace_id, string_agg('"' || r.event_id || '"', ',' ORDER BY r.ord) AS j FROM r ANTI JOIN pairs p ON p.trace_id = r.trace_id AND p.result_event_id = r.event_id GROUP BY 1)
        SELECT trace_id, 'sha256:' || sha256('{{"adapter_version":"1.0.0","call_pairs":[' || coalesce(p.j, '') || '],"events":[' || e.j || '],"lossy":' || (n % 2 = 0) || ',"orphan_result_event_ids":[' || coalesce(o.j, '') || '],"schema_version":"1.0.0","source_format":"generic_json"}}') AS hash FROM e LEFT JOIN p USING (trace_id) LEFT JOIN o USING (trace_id)""",
    "response_events": f"""WITH {_DONE} SELECT 's' || user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord,
        CASE event_type WHEN 'view' THEN 'message' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'state_change' ELSE 'tool_call' END AS kind, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'succeeded' WHEN 'purchase' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
        CASE event_type WHEN 'click' THEN 'c' || event_id WHEN 'purchase' THEN 'p' || event_id END AS call_id,
        CASE event_type WHEN 'view' THEN 'hi ' || event_id WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN '{{bad' ELSE '{{}}' END WHEN 'purchase' THEN '[1]' WHEN 'error' THEN 'boom ' || event_id ELSE '{{"name":"response_status","to":"in_progress"}}' END AS payload
        FROM m WHERE NOT (done AND event_type IN ('view', 'purchase'))""",
    "nested_calls": "SELECT 'message' AS kind, role, count(*) AS n FROM conversations GROUP BY role UNION ALL SELECT 'tool_call', NULL, count(*) FILTER (turn % 3 = 0) + count(*) FILTER (turn % 2 = 0) FROM conversations",
    "trace_summary": f"WITH {_GEN}, d AS (SELECT trace_id, sum(n)::bigint AS n FROM gd GROUP BY 1) SELECT trace_id, count(kind) AS n_events, coalesce(any_value(d.n), 0) AS n_diagnostics, 0 AS n_errors, count(*) > count(kind) AS lossy, false AS redacted, 0 AS n_redactions FROM gn LEFT JOIN d USING (trace_id) GROUP BY 1",
    "response_diagnostics": "SELECT 's' || user_id AS trace_id, 'MALFORMED_TOOL_ARGUMENTS' AS code, count(*) AS n FROM events WHERE event_type = 'click' AND event_id % 4 = 0 GROUP BY user_id",
    "response_fold": """WITH m AS (SELECT 'r' || (user_id % 50) AS trace_id, event_type, event_id % 40 AS id FROM events), done AS (SELECT DISTINCT trace_id, id FROM m WHERE event_type = 'click')
        SELECT m.trace_id, count(*) FILTER (event_type = 'click' OR (event_type = 'view' AND d.id IS NULL)) AS n_items, count(*) FILTER (event_type NOT IN ('view', 'click') AND d.id IS NULL) AS n_left FROM m LEFT JOIN done d ON d.trace_id = m.trace_id AND d.id = m.id GROUP BY 1""",
    "generic_diagnostics": f"WITH {_GEN} SELECT trace_id, code, pos, path, n::bigint AS n FROM gd",
    "progress_fold": """WITH m AS (SELECT 'run-' || user_id || '-' || (event_id % 9) AS run_id, event_id, event_type, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id, event_id % 9) AS stop FROM events),
        n AS (SELECT run_id, any_value(stop) AS stop, count(*) FILTER (event_type IN ('click', 'purchase') AND (stop IS NULL OR event_id < stop)) AS n_steps, coalesce(string_agg(event_type, ',' ORDER BY event_id) FILTER (event_type IN ('click', 'purchase') AND (stop IS NULL OR event_id < stop)), '') AS tools, min(event_id) FILTER (event_type = 'signup') AS done FROM m GROUP BY run_id)
        SELECT run_id, n_steps, tools, CASE WHEN stop IS NULL AND done IS NOT NULL THEN 'complete' ELSE 'error' END AS outcome, CASE WHEN stop IS NULL THEN 'r' || done END AS report_json, CASE WHEN stop IS NOT NULL THEN 'x' || stop WHEN done IS NULL THEN 'The run finished without a report.' END AS error FROM n""",
    "admission": """WITH RECURSIVE r AS (SELECT 'c' || (user_id % 20) AS client_id, event_id AS request_id, epoch_us(ts) / 1000000.0::double AS t, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events),
        w AS (SELECT client_id, request_id, t, n, t AS start, 1 AS used, true AS allowed, 2 AS remaining, 0 AS retry_after FROM r WHERE n = 1
          UNION ALL SELECT r.client_id, r.request_id, r.t, r.n, CASE WHEN r.t >= w.start + 3600 THEN r.t ELSE w.start END, CASE WHEN r.t >= w.start + 3600 THEN 1 WHEN w.used >= 3 THEN w.used ELSE w.used + 1 END, r.t >= w.start + 3600 OR w.used < 3,
            CASE WHEN r.t >= w.start + 3600 THEN 2 WHEN w.used >= 3 THEN 0 ELSE 2 - w.used END, CASE WHEN r.t >= w.start + 3600 OR w.used < 3 THEN 0 ELSE greatest(1, ceil(w.start + 3600 - r.t))::integer END FROM w JOIN r ON r.client_id = w.client_id AND r.n = w.n + 1)
        SELECT client_id, request_id, allowed, remaining::bigint AS remaining, retry_after::bigint AS retry_after FROM w""",
}
