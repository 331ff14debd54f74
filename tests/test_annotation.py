"""Annotation artifacts: blinding that can be undone, packets, responses, adjudication and frozen labels."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from wayline.operators import annotation, artifacts
from wayline.plans import job_queries

DECISION = f"item_id string, decision_status string, reliable boolean, primary_failure string, failures array<string>, evidence array<{artifacts.EVIDENCE}>, required_checks array<string>, confidence double, notes string"
CASES = "case_id string, item_id string, group_id string, counterfactual_pair_id string, style_pair_id string, source_id string, trace string"
DATASET = "d" * 64


def ref(item, name):
    return "ref-" + hashlib.sha256(f"{item}\0{name}".encode()).hexdigest()[:20]


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        ("case-1", "item-1", "case-10", None, "s", "x.y", "case-10 and case-1 and case-100\r\nfrom x.y, xzy and s\nlast"),
        ("case-2", "item-2", "case-2", "p-1", None, None, "only case-2 here\n\nand p-1"),
        ("case-3", "item-3", "g", None, None, None, ""),
    ]
    return artifacts.packet_items(spark.createDataFrame(rows, CASES)).cache()


def decision(item, status="final", reliable=True, primary=None, failures=(), evidence=((1, 1, None, None, None),), checks=("claim_support",), confidence=0.5, notes=None):
    kind = "supports_reliability" if reliable else "supports_failure" if reliable is False else "context"
    pieces = [(a, b, "case" if q is None else q, k or kind, f if f is not None or reliable is not False or k else primary, "why") for a, b, q, k, f in evidence]
    return (item, status, reliable, primary, list(failures), pieces, list(checks), confidence, notes)


def test_blinding_in_one_pass_and_back(spark, items):
    got = {r.item_id: r for r in items.collect()}
    lines = [x.text for x in got["item-1"].lines]
    assert lines == [f"{ref('item-1', 'group')} and item-1 and {ref('item-1', 'group')}0", f"from {ref('item-1', 'source')}, xzy and {ref('item-1', 'style')}", f"la{ref('item-1', 'style')}t"]
    assert [x.line_number for x in got["item-1"].lines] == [1, 2, 3] and got["item-1"].trace_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert [x.text for x in got["item-2"].lines] == ["only item-2 here", "", f"and {ref('item-2', 'counterfactual')}"] and [x.text for x in got["item-3"].lines] == [""]
    back = items.select("item_id", artifacts.swapped(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), artifacts.turned(F.col("swaps"))).alias("t"))
    assert {r.item_id: r.t for r in back.collect()} == {"item-1": "case-10 and case-1 and case-100\nfrom x.y, xzy and s\nlast", "item-2": "only case-2 here\n\nand p-1", "item-3": ""}


def packets(items, **other):
    facts = {"dataset_id": "set", "dataset_sha256": DATASET, "seed": "seed", "annotators": ("annotator-a", "annotator-b"), "codebook_version": "v1", "created_at": "2026-01-01T00:00:00Z"} | other
    headers, listed = artifacts.build_packets(items, **facts)
    return headers.cache(), listed.cache()


def test_packets_are_ordered_by_hash_and_hashed(spark, items):
    headers, listed = packets(items)
    order = {}
    for r in listed.orderBy("annotator_id", "pos").collect():
        order.setdefault(r.annotator_id, []).append(r.item_id)
    for who, found in order.items():
        assert found == sorted(["item-1", "item-2", "item-3"], key=lambda i: hashlib.sha256(f"seed\0{who}\0{i}".encode()).hexdigest())
    h = {r.annotator_id: r for r in headers.collect()}
    assert len({r.packet_id for r in h.values()} | {r.packet_sha256 for r in h.values()}) == 4
    assert {r.packet_sha256 for r in packets(items)[0].collect()} == {r.packet_sha256 for r in h.values()} and h["annotator-a"].packet_sha256 != packets(items, codebook_version="v2")[0].collect()[0].packet_sha256
    assert artifacts.check_packet(headers, listed, items, "set", DATASET).count() == 0
    with pytest.raises(ValueError):
        packets(items, annotators=("annotator-a", "annotator-a"))


def test_changed_packets_are_found(spark, items):
    headers, listed = packets(items)
    own = F.col("annotator_id") == "annotator-a"
    changes = {
        "line": (listed.withColumn("lines", F.when(own & (F.col("item_id") == "item-1"), F.slice("lines", 1, 2)).otherwise(F.col("lines"))), {("item-1", "trace_hash"), ("item-1", "item_differs"), (None, "packet_sha256")}),
        "less": (listed.where(~own | (F.col("item_id") != "item-2")), {("item-2", "missing"), (None, "packet_sha256")}),
        "twice": (listed.unionByName(listed.where(own & (F.col("item_id") == "item-2"))), {("item-2", "repeated"), (None, "packet_sha256")}),
        "other": (listed.withColumn("item_id", F.when(own & (F.col("item_id") == "item-3"), "item-9").otherwise(F.col("item_id"))), {("item-3", "missing"), ("item-9", "unexpected"), (None, "packet_sha256")}),
        "turned": (listed.withColumn("pos", F.when(own, 2 - F.col("pos")).otherwise(F.col("pos"))), {(None, "packet_sha256")}),
        "numbers": (listed.withColumn("lines", F.when(own & (F.col("item_id") == "item-3"), F.transform("lines", lambda x: F.struct((x["line_number"] - 1).alias("line_number"), x["text"].alias("text")))).otherwise(F.col("lines"))), {("item-3", "line_numbers"), ("item-3", "item_differs"), (None, "packet_sha256")}),
    }
    for name, (bad, expected) in changes.items():
        got = artifacts.check_packet(headers, bad, items, "set", DATASET).collect()
        assert {(r.item_id, r.rule) for r in got} == expected and {r.annotator_id for r in got} == {"annotator-a"}, name
    assert {r.rule for r in artifacts.check_packet(headers, listed, items, "other", "e" * 64).collect()} == {"dataset_id", "dataset_sha256"}


RULES = [
    ("decision_status", decision("i", "maybe", None, evidence=(), checks=(), notes="n")), ("failure_label", decision("i", reliable=False, primary="odd", failures=["odd"])), ("required_check", decision("i", checks=["odd"])),
    ("failures_repeated", decision("i", reliable=False, primary="masking_pattern", failures=["masking_pattern"] * 2)), ("checks_repeated", decision("i", checks=["claim_support"] * 2)), ("confidence_range", decision("i", confidence=1.1)), ("notes_length", decision("i", notes="")),
    ("evidence_kind", decision("i", evidence=[(1, 1, "x", "odd", None)])), ("evidence_span", decision("i", evidence=[(2, 1, "x", None, None)])), ("evidence_text", decision("i", evidence=[(1, 1, "", None, None)])),
    ("evidence_without_failure", decision("i", reliable=False, primary="masking_pattern", failures=["masking_pattern"], evidence=[(1, 1, "x", None, None), (1, 1, "x", "supports_failure", None)])), ("evidence_with_failure", decision("i", evidence=[(1, 1, "x", "supports_reliability", "masking_pattern")])),
    ("open_with_labels", decision("i", "abstain", True, evidence=(), notes="n")), ("open_without_notes", decision("i", "abstain", None, evidence=(), checks=())), ("open_with_evidence", decision("i", "ambiguous", None, evidence=[(1, 1, "x", "supports_reliability", None)], checks=(), notes="n")),
    ("final_without_verdict", decision("i", reliable=None, evidence=[(1, 1, "x", "context", None)])), ("final_without_evidence", decision("i", evidence=())), ("final_without_checks", decision("i", checks=())), ("reliable_with_failures", decision("i", primary="masking_pattern")), ("reliable_evidence", decision("i", evidence=[(1, 1, "x", "context", None)])),
    ("unreliable_without_primary", decision("i", reliable=False, failures=["masking_pattern"], evidence=[(1, 1, "x", "supports_failure", "masking_pattern")])), ("primary_not_listed", decision("i", reliable=False, primary="masking_pattern")),
    ("failure_without_evidence", decision("i", reliable=False, primary="masking_pattern", failures=["masking_pattern", "false_completion"])), ("evidence_of_other_failure", decision("i", reliable=False, primary="masking_pattern", failures=["masking_pattern"], evidence=[(1, 1, "x", None, None), (1, 1, "x", "supports_failure", "false_completion")])),
    ("unreliable_evidence", decision("i", reliable=False, primary="masking_pattern", failures=["masking_pattern"], evidence=[(1, 1, "x", None, None), (1, 1, "x", "context", None)])),
]
FINE = [decision("i"), decision("i", "abstain", None, evidence=[(1, 1, "x", "context", None)], checks=(), notes="unsure"), decision("i", reliable=False, primary="masking_pattern", failures=["masking_pattern"])]


def test_every_rule_of_decisions(spark):
    rows = spark.createDataFrame([(str(n), *d[1:]) for n, d in enumerate([d for _, d in RULES] + FINE)], DECISION)
    got = {}
    for r in artifacts.violations(rows, ["item_id"], artifacts.decision_rules()).collect():
        got.setdefault(int(r.item_id), set()).add(r.rule)
    assert all(rule in got[n] for n, (rule, _) in enumerate(RULES)) and set(got) == set(range(len(RULES))) and {r for r, _ in RULES} == set(artifacts.decision_rules())
    assert [n for n, rules in got.items() if len(rules) > 2] == []


def responses(headers, **changed):
    return headers.select("annotator_id", *[F.lit(changed[c]).alias(c) if c in changed else F.col(c) for c in ("packet_id", "packet_sha256", "dataset_id", "dataset_sha256", "codebook_version")], F.lit(changed.get("submitted_at", "2026-01-02T10:00:00+01:00")).alias("submitted_at"))


def test_responses_repeat_identities_cover_items_and_quote(spark, items):
    headers, listed = packets(items)
    one = headers.where("annotator_id = 'annotator-a'")
    said = lambda *rows: spark.createDataFrame(rows, DECISION).withColumn("annotator_id", F.lit("annotator-a"))
    two = [(1, 2, "here\n", None, None), (3, 3, ref("item-2", "counterfactual"), None, None)]
    good = [decision("item-1", evidence=[(1, 1, "and item-1", None, None)]), decision("item-2", evidence=two), decision("item-3", "abstain", None, evidence=(), checks=(), notes="empty")]
    check = lambda head, rows: {(r.item_id, r.rule) for r in artifacts.check_responses(head, rows, headers, listed).collect()}
    assert check(responses(one), said(*good)) == set()
    for field in ("packet_id", "packet_sha256", "dataset_id", "dataset_sha256", "codebook_version", "submitted_at"):
        assert check(responses(one, **{field: "other"}), said(*good)) == {(None, field)}
    assert check(responses(one).withColumn("annotator_id", F.lit("annotator-z")), said(*good).withColumn("annotator_id", F.lit("annotator-z"))) >= {(None, "unknown_annotator_id")}
    bad = [decision("item-1", evidence=[(1, 4, "x", None, None)]), decision("item-2", evidence=[(1, 1, "and", None, None)]), good[1], decision("item-9", evidence=[(1, 1, "x", None, None)])]
    assert check(responses(one), said(*bad)) == {("item-1", "evidence_beyond_lines"), ("item-2", "quote_not_verbatim"), ("item-2", "repeated"), ("item-3", "missing"), ("item-9", "unexpected")}


def sides(spark):
    agreed = decision("item-2", evidence=[(1, 1, "only item-2", None, None)], confidence=0.9)
    a = [decision("item-1", evidence=[(1, 2, f"{ref('item-1', 'group')}0\nfrom {ref('item-1', 'source')}", None, None), (3, 3, f"la{ref('item-1', 'style')}", None, None)]), agreed]
    b = [decision("item-1", reliable=False, primary="masking_pattern", failures=["masking_pattern"], evidence=[(1, 1, "and", None, None)]), (*agreed[:7], 0.1, "sure")]
    return (spark.createDataFrame(x, DECISION).cache() for x in (a, b))


def test_adjudication_and_frozen_labels(spark, items):
    a, b = sides(spark)
    pair = items.where("item_id <> 'item-3'")
    header = spark.createDataFrame([("set", DATASET, "v1", "annotator-a", "annotator-b")], "dataset_id string, dataset_sha256 string, codebook_version string, annotator_a string, annotator_b string")
    head, disputed = (x.cache() for x in artifacts.adjudication_packet(a, b, items, header, "adjudicator-c", "2026-01-03T00:00:00Z"))
    row = disputed.first()
    assert disputed.count() == 1 and row.item_id == "item-1" and len(row.lines) == 3 and row.annotation_a.reliable and row.annotation_b.primary_failure == "masking_pattern" and row.reasons == ["binary_reliability", "primary_failure", "failure_set", "evidence"]
    response = head.select("adjudicator_id", "packet_id", "packet_sha256", "comparison_sha256", "dataset_id", "dataset_sha256", "codebook_version")
    resolved = lambda rows, how, why="seen": rows.withColumns({"resolution": F.lit(how), "rationale": F.lit(why), "adjudicator_id": F.lit("adjudicator-c")})
    check = lambda rows, said=response: {(r.item_id, r.rule) for r in artifacts.check_adjudication(said, rows, head, disputed).collect()}
    from_a, from_b = a.where("item_id = 'item-1'"), b.where("item_id = 'item-1'")
    assert check(resolved(from_a, "annotation_a")) == check(resolved(from_b, "annotation_b")) == check(resolved(from_b, "independent_judgment")) == set()
    assert check(resolved(from_b, "annotation_a")) == {("item-1", "differs_from_a")} and check(resolved(from_a.withColumn("confidence", F.lit(0.6)), "annotation_b")) == {("item-1", "differs_from_b")}
    assert check(resolved(from_a, "odd", "")) == {("item-1", "resolution"), ("item-1", "rationale")} and check(resolved(a, "annotation_a")) == {("item-2", "unexpected")} and check(resolved(a.limit(0), "annotation_a")) == {("item-1", "missing")}
    open_ = spark.createDataFrame([decision("item-1", "abstain", None, evidence=(), checks=(), notes="n")], DECISION)
    lying = spark.createDataFrame([decision("item-1", evidence=[(1, 1, "never said", None, None)])], DECISION)
    assert check(resolved(open_, "independent_judgment")) == {("item-1", "not_final")} and check(resolved(lying, "independent_judgment")) == {("item-1", "quote_not_verbatim")}
    assert check(resolved(from_a, "annotation_a"), response.withColumn("comparison_sha256", F.lit("0"))) == {(None, "comparison_sha256")}

    frozen = artifacts.freeze_labels(a, b, resolved(from_a, "annotation_a"), pair).cache()
    got = {r.case_id: r for r in frozen.collect()}
    assert [e.quote for e in got["case-1"].gold_evidence] == ["case-100\nfrom x.y", "las"] and [e.quote for e in got["case-2"].gold_evidence] == ["only case-2"]
    assert (got["case-1"].resolution, got["case-1"].adjudicator_id, got["case-2"].resolution, got["case-2"].adjudicator_id) == ("adjudicated", "adjudicator-c", "independent_agreement", None)
    assert artifacts.check_frozen(frozen, pair).count() == 0 and [(r.item_id, r.rule) for r in artifacts.check_frozen(frozen, items).collect()] == [("item-3", "missing")]
    assert artifacts.freeze_labels(a, b, resolved(open_, "independent_judgment"), pair).count() == 1  # nobody decided the other finally
    facts = lambda status, at, adjudicator="adjudicator-c": spark.createDataFrame([("set", DATASET, "v1", "annotator-a", "annotator-b", adjudicator, "1" * 64, "2" * 64, "3" * 64, "2026-01-04T00:00:00Z", at, status, "fine")], "dataset_id string, dataset_sha256 string, codebook_version string, annotator_a string, annotator_b string, adjudicator_id string, response_sha256_a string, response_sha256_b string, adjudication_sha256 string, generated_at string, accepted_at string, acceptance_status string, acceptance_notes string")
    manifest = artifacts.freeze_manifest(frozen, facts("accepted", "2026-01-05T00:00:00Z"))
    m = manifest.first()
    assert (m["items"], m.agreed, m.adjudicated) == (2, 1, 1) and len(m.label_sha256) == 64 and artifacts.check_manifest(manifest).count() == 0
    rules = lambda f: {r.rule for r in artifacts.check_manifest(artifacts.freeze_manifest(frozen, f)).collect()}
    assert rules(facts("accepted", None)) == {"accepted_without_time"} and rules(facts("rejected", "2026-01-05T00:00:00Z")) == {"rejected_with_time"} and rules(facts("odd", "soon", "c")) == {"acceptance_status", "accepted_at", "adjudicator_name"}


def test_comparison_hash_ignores_order_and_confidence(spark, items):
    a, b = sides(spark)
    base = artifacts.comparison_sha256(a, b).first().sha256
    turned = a.withColumns({"evidence": F.reverse("evidence"), "confidence": F.lit(0.1), "notes": F.lit("n")})
    assert base == artifacts.comparison_sha256(turned, b).first().sha256 != artifacts.comparison_sha256(b, a).first().sha256
    assert annotation.disagreements(a, turned).count() == 0


def test_responses_that_break_several_rules_equal_their_sql(spark, tmp_path):
    """Document 798 is b's both by the rule of empty checks (no verdict) and by that of repeated ones."""
    docs = [(n, f"text {n}", "en", "src1", 8) for n in (8, 18, 78, 79, 798, 1038)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], 1, 0) for d in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("response_violations", "disagreements"):
        got = job_queries.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({job_queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_places_are_found_without_lines_and_keep_repeats(spark, items, monkeypatch):
    seen = []
    monkeypatch.setattr(artifacts, "running_sum", lambda df, *a, f=artifacts.running_sum: seen.append(df.columns) or f(df, *a))
    odd = spark.createDataFrame([(None, None, None, None, [])], items.schema)
    _, listed = artifacts.build_packets(items.unionByName(items.where("item_id = 'item-2'")).unionByName(odd), "set", DATASET, "seed", ("annotator-a", "annotator-b"), "v1", "2026-01-01T00:00:00Z")
    assert seen and "lines" not in seen[0]
    rows = listed.collect()
    want = {r.item_id: (r.trace_sha256, r.lines) for r in items.collect()} | {None: (None, None)}
    for a in ("annotator-a", "annotator-b"):
        own = [r for r in rows if r.annotator_id == a]
        assert sorted(r.pos for r in own) == list(range(5)) and sorted(str(r.item_id) for r in own) == ["None", "item-1", "item-2", "item-2", "item-3"]
        assert all((r.trace_sha256, r.lines) == want[r.item_id] for r in own)
