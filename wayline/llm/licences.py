"""Licence scan by canonical digests: whole texts, normalised, looked up among known licences.

The texts of a document are the document itself, its paragraphs (between blank lines) and
its lines.  Each is normalised: copyright lines go, case and punctuation too, and equivalent
spellings become one.  The digest of the whole normal form is hash-joined with those of
the known texts, a table of fixed size.  A known text of several paragraphs is found in a
larger document too, if the document holds each of these paragraphs.  Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayline.llm.licence_texts import known_texts

#: Spellings that count as equal, first is replaced by second (after case and punctuation).
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("initialise", "initialize"),
    ("realise", "realize"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("programme", "program"),
    ("fulfil", "fulfill"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("owner", "holder"),
    ("owners", "holders"),
    ("https", "http"),
]
#: Pairs of words that count as one.
JOINED = [("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("sub license", "sublicense"), ("share alike", "sharealike"), ("no derivatives", "noderivatives"), ("per cent", "percent")]
#: A line that opens with a copyright mark and a year, sign or name; not a sentence that wraps before "copyright holders".
COPYRIGHT_LINE = r"(?m:^[ \t]*(?:[Cc]opyright[ \t:]+(?:by |[^a-z\s])|COPYRIGHT[ \t:]+[^A-Za-z\s]|©|\([Cc]\))[^\n]*$)|(?i:all rights reserved)\.?"
#: Every known text and paragraph holds one of these once it is lower-cased, however its words are parted; others can't match.
HINT = r"licen[cs]|permission|provided|software|warranty|notice|public[^\p{L}\p{N}]+domain|(?:released|distributed|available)[^\p{L}\p{N}]+under"
PARAGRAPH = r"\n[ \t\r]*\n"


def normal_form(text: Column) -> Column:
    """Words of a text in one spelling, joined by single spaces."""
    bare = F.btrim(F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT_LINE, " ")), r"[^\p{L}\p{N}]+", " "))
    for a, b in JOINED:
        bare = F.replace(bare, F.lit(a), F.lit(b))
    spell = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    return F.array_join(F.transform(F.split(bare, " "), lambda w: F.coalesce(F.try_element_at(spell, w), w)), " ")


def _digest(text: Column) -> Column:
    return F.sha2(normal_form(text), 256)


def folder_texts(spark: SparkSession, path: str, group: str) -> DataFrame:
    """(licence, licence_group, text) of a folder of licence texts, a file each, named after its licence."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("licence"), F.lit(group).alias("licence_group"), F.col("value").alias("text"))


def known_digests(spark: SparkSession, texts: DataFrame | list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(digest, text_id, parts, licence, licence_group, within) of the known texts, or of ``texts`` (licence, licence_group, text).

    A row for each distinct normal form (``parts`` is 1), and a row for each paragraph of
    those with several (``parts`` is their number).  ``within``: other texts that hold all
    paragraphs of this one and more.
    """
    rows = texts if isinstance(texts, DataFrame) else spark.createDataFrame(texts if texts is not None else known_texts(), "licence string, licence_group string, text string")
    one = rows.groupBy(_digest(F.col("text")).alias("text_id")).agg(F.min("licence").alias("licence"), F.min_by("licence_group", "licence").alias("licence_group"), F.min_by("text", "licence").alias("text"))
    forms = F.array_distinct(F.filter(F.transform(F.split("text", PARAGRAPH), normal_form), lambda n: n != ""))
    cut = one.select("text_id", "licence", "licence_group", forms.alias("forms"))
    parts = cut.select(F.explode(F.transform("forms", lambda n: F.sha2(n, 256))).alias("digest"), "text_id", F.size("forms").alias("parts"), "licence", "licence_group")
    outer = parts.select("digest", F.col("text_id").alias("outer_id"), F.col("parts").alias("outer_parts"))
    shared = parts.join(outer, "digest").where("outer_parts > parts").groupBy("text_id", "outer_id", "parts").agg(F.count("*").alias("n")).where("n = parts")
    within = shared.groupBy("text_id").agg(F.collect_set("outer_id").alias("within"))
    every = one.select(F.col("text_id").alias("digest"), "text_id", F.lit(1).alias("parts"), "licence", "licence_group").unionByName(parts.where("parts > 1"))
    return every.join(within, "text_id", "left").select("digest", "text_id", "parts", "licence", "licence_group", F.coalesce("within", F.array().cast("array<string>")).alias("within"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", hint: str | None = None) -> DataFrame:
    """doc_id, n_texts (matched texts), licences and licence_groups (sorted arrays), a row per input row.

    A known text is matched by a unit that equals it, or by units that equal all its
    paragraphs; of texts that lie within each other the longest counts.

    ``known``: as :func:`known_digests` gives it.  All units of a text are looked up, or only
    those that match ``hint`` in lower case: a pattern that every known text and paragraph
    matches.  The built-in texts have one of their own.  A null or empty text has no licences; repeated rows are scanned each; equal texts
    within a document count once; an empty table gives an empty table; other columns are ignored.
    """
    if known is None:
        known, hint = F.broadcast(known_digests(docs.sparkSession)), HINT if hint is None else hint  # some hundred rows
    t = F.col("t")
    units = F.array_distinct(F.concat(F.array(t), F.split(t, PARAGRAPH), F.split(t, "\n")))
    some = F.filter(units, lambda u: F.lower(u).rlike(hint)) if hint else units
    looked = F.array_distinct(F.transform(some, _digest))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    each = rows.select("uid", "doc_id", F.explode_outer(F.when(F.lower("t").rlike(hint), looked) if hint else looked).alias("digest"))
    joined = each.join(known, "digest", "left")
    # A document's hits are at most the rows of the known table.
    hits = joined.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.collect_list(F.when(F.col("text_id").isNotNull(), F.struct("text_id", "parts", "licence", "licence_group", "within"))).alias("hits"))
    same = lambda g, h: (g["text_id"] == h["text_id"]) & (g["parts"] == h["parts"])
    whole = hits.withColumn("whole", F.filter("hits", lambda h: F.size(F.filter("hits", lambda g: same(g, h))) == h["parts"]))
    found = whole.select("doc_id", F.filter("whole", lambda h: ~F.arrays_overlap(h["within"], F.col("whole.text_id"))).alias("found"))
    return found.select("doc_id", F.size(F.array_distinct("found.text_id")).cast("long").alias("n_texts"), F.array_sort(F.array_distinct("found.licence")).alias("licences"), F.array_sort(F.array_distinct("found.licence_group")).alias("licence_groups"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_texts", F.array_join("licences", ",").alias("licences"), F.array_join("licence_groups", ",").alias("licence_groups"))


def _sql_normal(text: str) -> str:
    bare = f"trim(regexp_replace(lower(regexp_replace({text}, '{COPYRIGHT_LINE}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for a, b in JOINED:
        bare = f"replace({bare}, '{a}', '{b}')"
    spell = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS) + "}"
    return f"array_to_string(list_transform(string_split({bare}, ' '), lambda w: coalesce(({spell})[w], w)), ' ')"


def oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)}, {quote(c)})" for a, b, c in known_texts())
    return f"""
    WITH texts(licence, licence_group, text) AS (VALUES {values}),
    one AS (SELECT sha256({_sql_normal('text')}) AS text_id, min(licence) AS licence, arg_min(licence_group, licence) AS licence_group, arg_min(text, licence) AS text FROM texts GROUP BY 1),
    cut AS (SELECT DISTINCT text_id, {_sql_normal('p')} AS form FROM (SELECT text_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS p FROM one)),
    forms AS (SELECT text_id, form, count(*) OVER (PARTITION BY text_id) AS parts FROM cut WHERE form <> ''),
    parts AS (SELECT text_id, sha256(form) AS digest, parts FROM forms),
    within AS (SELECT a.text_id, b.text_id AS outer_id FROM parts a JOIN parts b USING (digest) WHERE b.parts > a.parts GROUP BY a.text_id, b.text_id, a.parts HAVING count(*) = a.parts),
    known AS (SELECT text_id AS digest, text_id, 1 AS parts FROM one UNION ALL SELECT digest, text_id, parts FROM parts WHERE parts > 1),
    units AS (
      SELECT doc_id, unnest(list_distinct([text] || regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') || string_split(text, chr(10)))) AS u FROM documents),
    digests AS (SELECT DISTINCT doc_id, sha256({_sql_normal('u')}) AS digest FROM units WHERE regexp_matches(lower(u), '{HINT}')),
    whole AS (SELECT DISTINCT doc_id, text_id FROM (SELECT doc_id, text_id, parts FROM digests JOIN known USING (digest) GROUP BY ALL HAVING count(*) = parts)),
    hits AS (SELECT doc_id, licence, licence_group FROM whole w JOIN one USING (text_id)
      WHERE NOT EXISTS (SELECT 1 FROM within i JOIN whole o ON o.text_id = i.outer_id WHERE i.text_id = w.text_id AND o.doc_id = w.doc_id))
    SELECT d.doc_id, count(h.licence) AS n_texts,
      coalesce(array_to_string(list_sort(list(DISTINCT h.licence) FILTER (h.licence IS NOT NULL)), ','), '') AS licences,
      coalesce(array_to_string(list_sort(list(DISTINCT h.licence_group) FILTER (h.licence_group IS NOT NULL)), ','), '') AS licence_groups
    FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id
    """
