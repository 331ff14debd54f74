"""Annotation artifacts: packets, responses, adjudication and frozen labels, with identities and verbatim evidence.

A header is a row, its items are rows of another table.  Items: (item_id, case_id, trace_sha256,
lines, swaps); lines are an array of (line_number, text) of the blinded trace, swaps the identifiers
that were replaced in it, so that quotes can be given back.  Decisions: (item_id, decision_status,
reliable, primary_failure, failures, evidence, required_checks, confidence, notes), evidence an array
of (line_start, line_end, quote, kind, failure, rationale).  Checks give a row per broken rule, never an error.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wayline.functions.json_values import canonical_json
from wayline.functions.lexicons import FAILURE_LABELS
from wayline.operators.annotation import VERSION, disagreements, sha_parts
from wayline.operators.integrity import normal_trace, table_sha
from wayline.operators.scoring import violations
from wayline.plans.running import running_sum

#: Columns of a case that identify it, and the name by which a reference to each is hashed.
IDENTIFIERS = {"group_id": "group", "counterfactual_pair_id": "counterfactual", "style_pair_id": "style", "source_id": "source"}
#: What decisions and evidence may be.
STATUSES = ["final", "abstain", "ambiguous"]
EVIDENCE_KINDS = ["supports_reliability", "supports_failure", "context"]
RESOLUTIONS = ["annotation_a", "annotation_b", "independent_judgment"]
CHECKS = ["artifact_provenance", "claim_support", "completion_evidence", "masking_language", "scope_coverage", "tool_outcome_consistency"]
ANNOTATOR = r"^annotator-[a-z0-9]+(?:[._-][a-z0-9]+)*$"
ADJUDICATOR = r"^adjudicator-[a-z0-9]+(?:[._-][a-z0-9]+)*$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})$"
DECISION = ["decision_status", "reliable", "primary_failure", "failures", "evidence", "required_checks", "confidence", "notes"]
EVIDENCE = "struct<line_start:bigint,line_end:bigint,quote:string,kind:string,failure:string,rationale:string>"


def swaps_of(cases: DataFrame) -> Column:
    """An array of (source, replacement): a row's identifiers and what stands for each, longer ones first; an identifier in two roles has the first."""
    own = [F.struct(F.col("case_id").alias("source"), F.col("item_id").alias("replacement"))]
    for c, name in IDENTIFIERS.items():
        if c in cases.columns:
            own.append(F.struct(F.col(c).alias("source"), F.concat(F.lit("ref-"), F.substring(sha_parts(F.col("item_id"), F.lit(name)), 1, 20)).alias("replacement")))
    known = F.filter(F.array(*own), lambda x: F.coalesce(x["source"] != "", F.lit(False)))
    first = F.filter(known, lambda x, i: ~F.exists(F.slice(known, 1, i), lambda y: y["source"] == x["source"]))
    by_length = F.array_sort(F.transform(first, lambda x: F.struct((-F.char_length(x["source"])).alias("n"), x["source"].alias("source"), x["replacement"].alias("replacement"))))
    return F.transform(by_length, lambda x: F.struct(x["source"].alias("source"), x["replacement"].alias("replacement")))


#: Texts that are Python objects at a time; all others of a batch stay in Arrow.
_AT_ONCE = 64


@F.arrow_udf(T.StringType())
def swapped(text: pa.Array, swaps: pa.Array) -> pa.Array:
    """The text with every source replaced in one pass; of sources that begin at one place the first in the list counts."""
    recent, done = {}, []
    for at in range(0, len(text), _AT_ONCE):
        out = []
        for t, pairs in zip(text[at : at + _AT_ONCE].to_pylist(), swaps[at : at + _AT_ONCE].to_pylist()):
            key = tuple(p["source"] for p in pairs or [])
            if t and key:
                if key not in recent:
                    recent = {key: re.compile("|".join(map(re.escape, key)))}
                by = {p["source"]: p["replacement"] for p in reversed(pairs)}
                t = recent[key].sub(lambda m, by=by: by[m[0]], t)
            out.append(t)
        done.append(pa.array(out, pa.string()))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def turned(swaps: Column) -> Column:
    """The swaps that undo others."""
    return F.transform(swaps, lambda x: F.struct(x["replacement"].alias("source"), x["source"].alias("replacement")))


def packet_items(cases: DataFrame) -> DataFrame:
    """The items of cases (case_id, item_id, trace, and identifiers); see the module."""
    rows = cases.select("item_id", "case_id", normal_trace(F.col("trace")).alias("trace"), swaps_of(cases).alias("swaps"))
    rows = rows.withColumn("text", swapped("trace", "swaps"))
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).cast("long").alias("line_number"), t.alias("text")))
    return rows.select("item_id", "case_id", F.sha2("text", 256).alias("trace_sha256"), lines.alias("lines"), "swaps")


def _line_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def _headed(headers: DataFrame, items: DataFrame, fields: list[str], key: str) -> DataFrame:
    """``headers`` with packet_sha256: a hash of ``fields`` and of a tree of the items' hashes, in order by pos."""
    trees = table_sha(items, F.concat_ws("|", F.col("pos").cast("string"), F.col("digest")), keys=[key])
    return headers.join(trees, key, "left").withColumn("packet_sha256", sha_parts(*[F.col(c) for c in fields], F.coalesce("sha256", F.lit("")))).drop("n", "sha256")


_PACKET = ["version", "packet_id", "dataset_id", "dataset_sha256", "codebook_version", "annotator_id", "created_at"]


def _item_digest() -> Column:
    return F.sha2(canonical_json(F.to_json(F.struct("item_id", "trace_sha256", "lines"))), 256)


def build_packets(items: DataFrame, dataset_id: str, dataset_sha256: str, seed: str, annotators: tuple[str, str], codebook_version: str, created_at: str) -> tuple[DataFrame, DataFrame]:
    """(headers, items) of two packets of the same items, each in an order of its own by hash.

    packet_sha256 covers the header and, by a tree of hashes, all items in order.
    """
    if len(set(annotators)) != 2:
        raise ValueError("two different annotators are needed")
    spark = items.sparkSession
    heads = spark.createDataFrame([(VERSION, dataset_id, dataset_sha256, codebook_version, a, created_at) for a in annotators], "version string, dataset_id string, dataset_sha256 string, codebook_version string, annotator_id string, created_at string")
    packet = sha_parts(F.lit(VERSION), F.col("dataset_sha256"), F.col("codebook_version"), F.col("annotator_id"), F.col("created_at"), F.lit(seed))
    heads = heads.withColumn("packet_id", F.concat(F.lit("packet-"), F.substring(packet, 1, 24)))
    # Places are found without the lines, which join them by what they are the lines of; repeated items stay repeated.
    own = ["item_id", "trace_sha256"]
    dealt = items.select(*own, F.explode(F.array(*[F.lit(a) for a in annotators])).alias("annotator_id"))
    dealt = dealt.withColumn("place", sha_parts(F.lit(seed), F.col("annotator_id"), F.col("item_id"))).withColumn("one", F.lit(1).cast("long"))
    placed = running_sum(dealt.select("annotator_id", "place", *own, "one"), ["annotator_id", "place", "item_id"], "one", "annotator_id", "pos")
    digested = items.select(*[F.col(c).alias(f"_{c}") for c in own], *own, "lines").dropDuplicates(own).withColumn("digest", _item_digest()).drop(*own)
    listed = placed.join(digested, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own]).select("annotator_id", "pos", *own, "lines", "digest")
    return _headed(heads, listed, _PACKET, "annotator_id"), listed.drop("digest")


def _rule(df: DataFrame, name: str, *keys: str) -> DataFrame:
    return df.select(*[F.col(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in keys], F.lit(name).alias("rule"))


def _coverage(actual: DataFrame, expected: DataFrame, group: str) -> DataFrame:
    """Items that are missing, unexpected or repeated, for every group of ``actual`` that ``expected`` (group, item_id) names."""
    n = actual.groupBy(group, "item_id").agg(F.count("*").alias("n"))
    j = n.join(expected.select(group, "item_id", F.lit(True).alias("due")), [group, "item_id"], "full_outer")
    rule = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return j.select(group, "item_id", rule.alias("rule")).where("rule is not null")


def _identity(headers: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row (key, null, field) for every field in which a header differs from the expected one of its key, and unknown_<key> where there is none."""
    names = [c for c in fields if c != key]
    j = headers.join(expected.select(key, *[F.col(c).alias(f"x_{c}") for c in names], F.lit(True).alias("known")), key, "left")
    rules = {f"unknown_{key}": F.col("known").isNull()} | {c: F.col("known") & ~F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in names}
    return violations(j, [key, F.lit(None).cast("string").alias("item_id")], rules)


def check_packet(headers: DataFrame, listed: DataFrame, items: DataFrame, dataset_id: str, dataset_sha256: str) -> DataFrame:
    """(annotator_id, item_id, rule): headers of another data set or whose hash is not that of their items, and items that are missing, unexpected, repeated, changed or badly numbered.

    ``items`` are those that the packets should hold.
    """
    again = _headed(headers.select(*_PACKET, F.col("packet_sha256").alias("claimed")), listed.withColumn("digest", _item_digest()), _PACKET, "annotator_id")
    heads = violations(
        again, ["annotator_id", F.lit(None).cast("string").alias("item_id")],
        {"dataset_id": F.col("dataset_id") != dataset_id, "dataset_sha256": F.col("dataset_sha256") != dataset_sha256, "annotator_name": ~F.col("annotator_id").rlike(ANNOTATOR), "created_at": ~F.col("created_at").rlike(TIMESTAMP), "packet_sha256": F.col("packet_sha256") != F.col("claimed")},
    )
    covered = _coverage(listed, headers.select("annotator_id").distinct().join(items.select("item_id")), "annotator_id")
    j = listed.join(items.select("item_id", F.col("trace_sha256").alias("x_sha"), F.col("lines").alias("x_lines")), "item_id")
    numbers = F.transform(F.col("lines"), lambda x: x["line_number"])
    counted = F.when(F.size("lines") > 0, F.sequence(F.lit(1).cast("long"), F.size("lines").cast("long")))
    own = violations(
        j, ["annotator_id", "item_id"],
        {"line_numbers": ~numbers.eqNullSafe(counted), "trace_hash": F.sha2(_line_text(F.col("lines")), 256) != F.col("trace_sha256"), "item_differs": (F.col("trace_sha256") != F.col("x_sha")) | ~F.col("lines").eqNullSafe(F.col("x_lines"))},
    )
    return heads.unionByName(covered).unionByName(own)


def decision_rules(c=F.col) -> dict[str, Column]:
    """The rules of decisions, by name; every column is found by ``c``."""
    status, reliable, primary, failures, evidence, checks = (c(n) for n in DECISION[:6])
    final = status == "final"
    open_ = ~final
    some = lambda test: F.exists(evidence, test)
    repeats = lambda x: F.size(F.array_distinct(x)) < F.size(x)
    blank = lambda x, most: x.isNull() | (x == "") | (F.char_length(x) > most)
    return {
        "decision_status": ~status.isin(*STATUSES),
        "failure_label": F.exists(failures, lambda f: ~f.isin(*FAILURE_LABELS)) | (primary.isNotNull() & ~primary.isin(*FAILURE_LABELS)),
        "required_check": F.exists(checks, lambda x: ~x.isin(*CHECKS)),
        "failures_repeated": repeats(failures),
        "checks_repeated": repeats(checks),
        "confidence_range": ~c("confidence").between(0, 1) | c("confidence").isNull(),
        "notes_length": c("notes").isNotNull() & blank(c("notes"), 2000),
        "evidence_kind": some(lambda e: ~e["kind"].isin(*EVIDENCE_KINDS)),
        "evidence_span": some(lambda e: (e["line_start"] < 1) | (e["line_end"] < e["line_start"])),
        "evidence_text": some(lambda e: (e["quote"] == "") | blank(e["rationale"], 1000)),
        "evidence_without_failure": some(lambda e: (e["kind"] == "supports_failure") & e["failure"].isNull()),
        "evidence_with_failure": some(lambda e: (e["kind"] != "supports_failure") & e["failure"].isNotNull()),
        "open_with_labels": open_ & (reliable.isNotNull() | primary.isNotNull() | (F.size(failures) > 0) | (F.size(checks) > 0)),
        "open_without_notes": open_ & c("notes").isNull(),
        "open_with_evidence": open_ & some(lambda e: (e["kind"] != "context") | e["failure"].isNotNull()),
        "final_without_verdict": final & reliable.isNull(),
        "final_without_evidence": final & (F.size(evidence) == 0),
        "final_without_checks": final & (F.size(checks) == 0),
        "reliable_with_failures": final & reliable & ((F.size(failures) > 0) | primary.isNotNull()),
        "reliable_evidence": final & reliable & some(lambda e: e["kind"] != "supports_reliability"),
        "unreliable_without_primary": final & ~reliable & primary.isNull(),
        "primary_not_listed": final & ~reliable & primary.isNotNull() & ~F.array_contains(failures, primary),
        "failure_without_evidence": final & ~reliable & F.exists(failures, lambda f: ~some(lambda e: F.coalesce((e["kind"] == "supports_failure") & (e["failure"] == f), F.lit(False)))),
        "evidence_of_other_failure": final & ~reliable & some(lambda e: e["failure"].isNotNull() & ~F.array_contains(failures, e["failure"])),
        "unreliable_evidence": final & ~reliable & some(lambda e: e["kind"] != "supports_failure"),
    }


def _anchors(decisions: DataFrame, items: DataFrame, group: str) -> DataFrame:
    """Evidence that ends behind the last line, or whose quote isn't in the lines that it names."""
    each = decisions.select(group, "item_id", F.explode("evidence").alias("e")).join(items.select("item_id", "lines"), "item_id")
    inside = (F.col("e.line_start") >= 1) & (F.col("e.line_end") >= F.col("e.line_start")) & (F.col("e.line_end") <= F.size("lines"))
    span = F.when(inside, _line_text(F.slice("lines", F.col("e.line_start").cast("int"), (F.col("e.line_end") - F.col("e.line_start") + 1).cast("int"))))
    return violations(each, [group, "item_id"], {"evidence_beyond_lines": F.col("e.line_end") > F.size("lines"), "quote_not_verbatim": ~F.contains(span, F.col("e.quote"))})


_SHARED = ["packet_id", "packet_sha256", "dataset_id", "dataset_sha256", "codebook_version"]


def check_responses(responses: DataFrame, decisions: DataFrame, headers: DataFrame, listed: DataFrame) -> DataFrame:
    """(annotator_id, item_id, rule) of responses to packets.

    ``responses``: a header row per annotator with the identities of the packet and submitted_at;
    ``decisions``: their decisions with annotator_id.  A header must repeat its packet's
    identities, decisions must cover the packet once, follow :func:`decision_rules` and quote
    the packet's lines verbatim.
    """
    heads = _identity(responses, headers, "annotator_id", _SHARED).unionByName(violations(responses, ["annotator_id", F.lit(None).cast("string").alias("item_id")], {"submitted_at": ~F.coalesce(F.col("submitted_at").rlike(TIMESTAMP), F.lit(False))}))
    answered = responses.select("annotator_id").distinct()
    covered = _coverage(decisions, listed.join(answered, "annotator_id", "left_semi"), "annotator_id")
    lines = listed.groupBy("item_id").agg(F.first("lines").alias("lines"))  # the same in all packets of a build
    return heads.unionByName(covered).unionByName(violations(decisions, ["annotator_id", "item_id"], decision_rules())).unionByName(_anchors(decisions, lines, "annotator_id").distinct())


def normal_decision(c=F.col) -> Column:
    """The JSON text of a decision as it counts: sets sorted, evidence in order of its JSON, without confidence and notes."""
    quoted = F.transform(c("evidence"), lambda e: F.to_json(F.struct(e["failure"].alias("failure"), e["kind"].alias("kind"), e["line_end"].alias("line_end"), e["line_start"].alias("line_start"), e["quote"].alias("quote"), e["rationale"].alias("rationale")), {"ignoreNullFields": "false"}))
    head = F.to_json(F.struct(c("decision_status").alias("decision_status")))
    tail = F.to_json(F.struct(F.array_sort(c("failures")).alias("failures"), c("primary_failure").alias("primary_failure"), c("reliable").alias("reliable"), F.array_sort(c("required_checks")).alias("required_checks")), {"ignoreNullFields": "false"})
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"evidence":['), F.array_join(F.array_sort(quoted), ","), F.lit("],"), F.regexp_replace(tail, r"^\{", ""))


_ADJUDICATION = ["version", "packet_id", "comparison_sha256", "dataset_id", "dataset_sha256", "codebook_version", "annotator_a", "annotator_b", "adjudicator_id", "created_at"]


def comparison_sha256(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n and sha256 of all items with both decisions as they count and the reasons by which they differ."""
    whole = lambda df, s: df.select("item_id", normal_decision().alias(s))
    j = whole(a, "a").join(whole(b, "b"), "item_id", "full_outer").join(disagreements(a, b), "item_id", "left")
    return table_sha(j, F.concat_ws("\n", "item_id", F.coalesce("a", F.lit("-")), F.coalesce("b", F.lit("-")), F.array_join("reasons", ",")))


def adjudication_packet(a: DataFrame, b: DataFrame, items: DataFrame, header: DataFrame, adjudicator_id: str, created_at: str) -> tuple[DataFrame, DataFrame]:
    """(header, items): the disputed items with their lines, the reasons, and both decisions.

    ``header``: one row (dataset_id, dataset_sha256, codebook_version, annotator_a, annotator_b).
    """
    side = lambda df, s: df.select("item_id", F.struct(*DECISION).alias(f"annotation_{s}"))
    disputed = disagreements(a, b).join(side(a, "a"), "item_id").join(side(b, "b"), "item_id").join(items.select("item_id", "trace_sha256", "lines"), "item_id")
    head = header.join(comparison_sha256(a, b).select(F.col("sha256").alias("comparison_sha256"))).withColumns({"version": F.lit(VERSION), "adjudicator_id": F.lit(adjudicator_id), "created_at": F.lit(created_at)})
    head = head.withColumn("packet_id", F.concat(F.lit("adjudication-"), F.substring(sha_parts(F.col("comparison_sha256"), F.col("adjudicator_id"), F.col("created_at")), 1, 24)))
    return _adjudication_hash(head, disputed), disputed


def _adjudication_hash(head: DataFrame, disputed: DataFrame) -> DataFrame:
    digest = F.sha2(canonical_json(F.to_json(F.struct("item_id", "trace_sha256", "lines", "reasons", "annotation_a", "annotation_b"), {"ignoreNullFields": "false"})), 256)
    tree = table_sha(disputed, F.concat_ws("|", "item_id", digest)).select(F.col("sha256").alias("tree"))
    return head.join(tree).withColumn("packet_sha256", sha_parts(*[F.col(c) for c in _ADJUDICATION], F.col("tree"))).drop("tree")


def check_adjudication(response: DataFrame, resolutions: DataFrame, head: DataFrame, disputed: DataFrame) -> DataFrame:
    """(adjudicator_id, item_id, rule) of an adjudication.

    ``response``: one row that repeats the packet's identities; ``resolutions``: (adjudicator_id,
    item_id, resolution, rationale and a decision's columns).  Resolutions cover the disputed items
    once, are final, follow the rules of decisions with verbatim quotes, and equal in all
    their parts the side that they select.
    """
    heads = _identity(response, head, "adjudicator_id", [*_SHARED, "comparison_sha256"])
    names = violations(head, ["adjudicator_id", F.lit(None).cast("string").alias("item_id")], {"annotators_equal": F.col("annotator_a") == F.col("annotator_b"), "adjudicator_name": ~F.col("adjudicator_id").rlike(ADJUDICATOR)})
    covered = _coverage(resolutions, disputed.select("item_id").join(response.select("adjudicator_id").distinct()), "adjudicator_id")
    j = resolutions.join(disputed.select("item_id", "annotation_a", "annotation_b"), "item_id")
    decision = F.to_json(F.struct(*DECISION), {"ignoreNullFields": "false"})
    same = lambda s: decision == F.to_json(F.col(s), {"ignoreNullFields": "false"})
    own = {
        "resolution": ~F.col("resolution").isin(*RESOLUTIONS), "rationale": F.col("rationale").isNull() | (F.col("rationale") == "") | (F.char_length("rationale") > 2000), "not_final": F.col("decision_status") != "final",
        "differs_from_a": (F.col("resolution") == "annotation_a") & ~same("annotation_a"), "differs_from_b": (F.col("resolution") == "annotation_b") & ~same("annotation_b"),
    }
    rules = violations(j, ["adjudicator_id", "item_id"], own | decision_rules())
    return heads.unionByName(names).unionByName(covered).unionByName(rules).unionByName(_anchors(resolutions, disputed, "adjudicator_id").distinct())


def freeze_labels(a: DataFrame, b: DataFrame, resolutions: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, item_id, reliable, primary_failure, failures, gold_evidence, required_checks, review_status, resolution, decision_sha256, adjudicator_id), a row per item with a final decision.

    Agreed items are A's, disputed ones as resolved; sets are sorted and identifiers stand
    in quotes again.  Items that nobody decided finally have no row (see :func:`check_frozen`).
    """
    disputed = disagreements(a, b).select("item_id")
    none = F.lit(None).cast("string")
    agreed = a.join(b.select("item_id"), "item_id", "left_semi").join(disputed, "item_id", "left_anti").select("item_id", *DECISION, F.lit("independent_agreement").alias("resolution"), none.alias("adjudicator_id"))
    solved = resolutions.join(disputed, "item_id", "left_semi").select("item_id", *DECISION, F.lit("adjudicated").alias("resolution"), "adjudicator_id")
    rows = agreed.unionByName(solved).where("decision_status = 'final' and reliable is not null").join(items.select("item_id", "case_id", "swaps"), "item_id").withColumn("decision_sha256", F.sha2(normal_decision(), 256))
    # Quotes go through one column function: an item's quotes as rows, then together again.
    quotes = rows.select("item_id", "swaps", F.posexplode("evidence").alias("i", "e")).withColumn("quote", swapped(F.col("e.quote"), turned(F.col("swaps"))))
    given = F.struct("i", F.col("e.line_start").alias("line_start"), F.col("e.line_end").alias("line_end"), "quote", F.col("e.kind").alias("kind"), F.col("e.failure").alias("failure"), F.col("e.rationale").alias("rationale"))
    back = quotes.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(given)), lambda x: x.dropFields("i")).alias("gold_evidence"))
    return rows.join(back, "item_id", "left").select(
        *["case_id", "item_id", "reliable", "primary_failure", F.array_sort("failures").alias("failures"), F.coalesce("gold_evidence", F.array().cast(f"array<{EVIDENCE}>")).alias("gold_evidence"), F.array_sort("required_checks").alias("required_checks")],
        *[F.lit("frozen").alias("review_status"), "resolution", "decision_sha256", "adjudicator_id"],
    )


def check_frozen(frozen: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rule): items without a label, labels of no item, and repeated labels."""
    group = lambda df: df.select("item_id", F.lit("all").alias("g"))
    return _coverage(group(frozen), group(items), "g").drop("g")


_MANIFEST = ["annotator_a", "annotator_b", "adjudicator_id", "response_sha256_a", "response_sha256_b", "adjudication_sha256", "generated_at", "accepted_at", "acceptance_status", "acceptance_notes"]


def freeze_manifest(frozen: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: ``facts`` (one row: dataset_id, dataset_sha256, codebook_version, annotators, response hashes, times, acceptance) with label_sha256, items, agreed and adjudicated."""
    line = F.to_json(F.struct("case_id", "reliable", "primary_failure", "failures", "gold_evidence", "required_checks", "review_status"), {"ignoreNullFields": "false"})
    counts = {"agreed": F.when(F.col("resolution") == "independent_agreement", 1).otherwise(0), "adjudicated": F.when(F.col("resolution") == "adjudicated", 1).otherwise(0)}
    return facts.join(table_sha(frozen, canonical_json(line), counts).select(F.col("n").alias("items"), *counts, F.col("sha256").alias("label_sha256")))


def check_manifest(manifest: DataFrame) -> DataFrame:
    """(dataset_id, rule) of manifests: two annotators, times as instants, a time of acceptance exactly where accepted, and notes."""
    status, at, when = F.col("acceptance_status"), F.col("accepted_at"), lambda c: F.coalesce(F.col(c).rlike(TIMESTAMP), F.lit(False))
    rules = {
        "annotators_equal": F.col("annotator_a") == F.col("annotator_b"), "annotator_name": ~F.col("annotator_a").rlike(ANNOTATOR) | ~F.col("annotator_b").rlike(ANNOTATOR), "adjudicator_name": F.col("adjudicator_id").isNotNull() & ~F.col("adjudicator_id").rlike(ADJUDICATOR),
        "acceptance_status": ~status.isin("accepted", "rejected"), "accepted_without_time": (status == "accepted") & at.isNull(), "rejected_with_time": (status == "rejected") & at.isNotNull(), "generated_at": ~when("generated_at"), "accepted_at": at.isNotNull() & ~when("accepted_at"),
        "acceptance_notes": F.col("acceptance_notes").isNull() | (F.col("acceptance_notes") == "") | (F.char_length("acceptance_notes") > 2000), "adjudication": (F.col("adjudicated") > 0) & (F.col("adjudication_sha256").isNull() | F.col("adjudicator_id").isNull()),
    }
    return violations(manifest, ["dataset_id"], rules)
