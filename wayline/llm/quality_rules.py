"""Quality rules from document counts and from the frequency of lines across documents.

Only DataFrame functions: texts are read once, into a table of counts and line hashes per
document; everything across documents works on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayline.plans.storage import materialize

SPACE = " \t\n\x0b\x0c\r"
_WORD_GAP = r"[ \x09-\x0D]+"

#: A line is boilerplate on a host beyond this many distinct documents, and beyond this share of the host's documents.
MAX_DOCS_PER_HOST = 10
MAX_SHARE_OF_HOST = 0.02
#: A document goes if less than this share of its line characters is left.
LEAST_LEFT = 0.2


def _blank(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE)) == ""


def _normal(line: Column) -> Column:
    """Lower case; a run of digits is one 0, other runs of neither letters nor digits are one space between words and nothing at the ends.  Lines without letters keep their characters, with single spaces."""
    words = F.regexp_replace(F.regexp_replace(line, r"\p{Nd}+", "0"), r"[^\p{L}\p{N}]+", " ")
    return F.when(line.rlike(r"\p{L}"), F.lower(F.trim(words))).otherwise(F.btrim(F.regexp_replace(line, _WORD_GAP, " ")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores ahead until no column of ``df`` has them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row per input row: doc_id, keys, the base counts, and (hash, characters) of each line with a word."""
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    a = t.select(
        "doc_id",
        "host",
        F.xxhash64("doc_id", "host").alias("k1"),
        F.xxhash64("t").alias("k2"),
        "t",
        F.when(_blank(F.col("t")), F.array().cast("array<string>")).otherwise(F.split(F.btrim("t", F.lit(SPACE)), _WORD_GAP)).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: ~_blank(x)).alias("lines"),
    )
    b = a.select(
        *["doc_id", "host", "k1", "k2"],
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(_normal(x)).alias("h"), F.char_length(x).alias("n"))).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("wh"),
    )
    at = lambda i: [F.get(F.col("wh"), i + k) for k in range(5)]
    c = b.withColumn("win", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.size("wh") - 5), lambda i: F.xxhash64(*at(i))))).drop("wh")
    # Only texts with a window found twice go on to sorting.
    d = c.withColumn("s", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("win")
    same = lambda x, i, step: x["h"] == F.get(F.col("s"), i + step)["h"]
    e = d.withColumn("p", F.array_sort(F.transform(F.filter("s", lambda x, i: F.coalesce(same(x, i, 1), F.lit(False)) | F.coalesce((i > 0) & same(x, i, -1), F.lit(False))), lambda x: x["i"]))).drop("s")
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + 5 - F.greatest(acc["end"], i)).alias("n"), (i + 5).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    return e.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")


def _document(copies_count_once: bool) -> Column:
    """What makes a row a document of its own: id and text, or the text alone."""
    return F.col("k2") if copies_count_once else F.xxhash64("k1", "k2")


def _line_rows(counts: DataFrame, copies_count_once: bool = False) -> DataFrame:
    """A row per document and line: document, host, the line's key on its host, its hash and characters."""
    rows = counts.select("k1", "k2", F.xxhash64("host").alias("on"), _document(copies_count_once).alias("document"), F.explode("lines").alias("x"))
    return rows.select("k1", "k2", "on", "document", F.xxhash64("on", "x.h").alias("line"), F.col("x.h").alias("h"), F.col("x.n").cast("long").alias("chars"))


def frequent_lines(counts: DataFrame, max_docs_per_host: int = MAX_DOCS_PER_HOST, max_share_of_host: float = MAX_SHARE_OF_HOST, copies_count_once: bool = False) -> DataFrame:
    """(line, documents): lines, by host, that more than ``max_docs_per_host`` distinct documents hold, and more than ``max_share_of_host`` of the host's.

    Rows of one id and text are one document; with ``copies_count_once`` all rows of one text are.
    """
    often = _line_rows(counts, copies_count_once).groupBy("on", "line").agg(F.countDistinct("document").alias("documents")).where(F.col("documents") > max_docs_per_host)
    hosts = counts.groupBy(F.xxhash64("host").alias("on")).agg(F.countDistinct(_document(copies_count_once)).alias("of"))
    return often.join(hosts, "on").where(F.col("documents") > max_share_of_host * F.col("of")).select("line", "documents")


def _key(id_col: str, text_col: str, host_col: str) -> list[Column]:
    return [F.xxhash64(F.col(id_col).cast("long"), F.col(host_col).cast("string")), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))]


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs_per_host: int, max_share_of_host: float, least_left: float, copies_count_once: bool) -> DataFrame:
    """:func:`verdicts` with ``gone``, the hashes of the document's lines above the limits (null if it has none)."""
    counts = materialize(document_counts(docs, id_col, text_col, host_col), "counts")
    frequent = frequent_lines(counts, max_docs_per_host, max_share_of_host, copies_count_once).select("line")
    # A line that occurs several times in a text is removed each time; repeated rows of one document are counted once.
    each = _line_rows(counts).join(frequent, "line", "left_semi").groupBy("k1", "k2", "h").agg(F.sum("chars").alias("chars"))
    copies = counts.groupBy("k1", "k2").agg(F.count("*").alias("rows"))
    removed = each.groupBy("k1", "k2").agg(F.sum("chars").alias("removed_chars"), F.collect_list("h").alias("gone"))
    per_key = copies.join(removed, ["k1", "k2"], "left").select("k1", "k2", (F.coalesce("removed_chars", F.lit(0)) / F.col("rows")).cast("long").alias("removed_chars"), "gone")
    out = counts.select(
        *["doc_id", "k1", "k2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("line_chars"),
    ).join(per_key, ["k1", "k2"])
    depleted = F.col("line_chars") - F.col("removed_chars") < least_left * F.col("line_chars")
    return out.withColumn("kept", ~(F.col("base_failed") | depleted))


def verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs_per_host: int = MAX_DOCS_PER_HOST, max_share_of_host: float = MAX_SHARE_OF_HOST, least_left: float = LEAST_LEFT, copies_count_once: bool = False
) -> DataFrame:
    """A row per input row: doc_id, keys k1 and k2, base counts, base_failed, line_chars, removed_chars, kept.

    A null text counts as empty (no words, so the base rule fails); a null host is a host
    of its own; rows with a null id are told apart by their texts; repeated rows get equal
    verdicts; an empty table gives an empty table; further columns are ignored, whatever
    their names.  Ties play no part: every rule is a count.
    """
    return _judged(docs, id_col, text_col, host_col, max_docs_per_host, max_share_of_host, least_left, copies_count_once).drop("gone")


def _without(text_col: str, gone: str) -> Column:
    """The text without the lines whose hashes are in ``gone``; as it is where that is null."""
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda x: _blank(x) | ~F.array_contains(gone, F.xxhash64(_normal(x)))), "\n")
    return F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)


def _with_marks(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with what ``marks`` (k1, k2, ...) say of their rows, and the names under which it stands there."""
    names = unused(docs, "k1", "k2", *[c for c in marks.columns if c not in ("k1", "k2")])
    k1, k2 = _key(id_col, text_col, host_col)
    return docs.withColumn(names[0], k1).withColumn(names[1], k2).join(marks.select("k1", "k2", *[c for c in marks.columns if c not in ("k1", "k2")]).toDF(*names), names[:2], "left"), names[2:]


def remove_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """``docs`` with the lines above the limits of :func:`frequent_lines` taken out of the text; other columns, of any name, and rows as they were (a null text stays null)."""
    counts = materialize(document_counts(docs, id_col, text_col, host_col), "counts")
    hits = _line_rows(counts).join(frequent_lines(counts, **limits).select("line"), "line", "left_semi").groupBy("k1", "k2").agg(F.collect_set("h").alias("gone"))
    joined, (gone,) = _with_marks(docs, hits, id_col, text_col, host_col)
    return joined.withColumn(text_col, _without(text_col, gone)).select(*docs.columns)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that :func:`verdicts` keeps, with their columns, of any name."""
    marks = verdicts(docs, id_col, text_col, host_col, **limits).where(~F.col("kept")).select("k1", "k2", F.lit(True).alias("bad")).distinct()
    joined, (bad,) = _with_marks(docs, marks, id_col, text_col, host_col)
    return joined.where(F.col(bad).isNull()).select(*docs.columns)


def keep_clean(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs_per_host: int = MAX_DOCS_PER_HOST, max_share_of_host: float = MAX_SHARE_OF_HOST, least_left: float = LEAST_LEFT, copies_count_once: bool = False
) -> DataFrame:
    """The rows that :func:`verdicts` keeps, with the lines above the limits taken out of their texts; other columns, of any name, as they were."""
    judged = _judged(docs, id_col, text_col, host_col, max_docs_per_host, max_share_of_host, least_left, copies_count_once).where(~F.col("kept") | F.col("gone").isNotNull())
    # Rows of one key have equal verdicts and lines.
    marks = judged.groupBy("k1", "k2").agg(F.bool_and("kept").alias("kept"), F.first("gone").alias("gone"))
    joined, (kept, gone) = _with_marks(docs, marks, id_col, text_col, host_col)
    return joined.where(F.coalesce(kept, F.lit(True))).withColumn(text_col, _without(text_col, gone)).select(*docs.columns)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def oracle() -> str:
    """The same verdicts in SQL, with lines compared as texts; ids are unique there."""
    gap = "[ \\x09-\\x0D]"
    return f"""
WITH w AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{gap}+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, unnest(generate_series(1, len(words) - 4)) AS i, words FROM w WHERE len(words) >= 5),
grams AS (SELECT doc_id, i, words[i:i + 4] AS g FROM win),
twice AS (SELECT doc_id, unnest(positions) AS i FROM (SELECT doc_id, list(i) AS positions FROM grams GROUP BY doc_id, g HAVING count(*) > 1)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM twice) GROUP BY doc_id),
each AS (SELECT doc_id, host, length(x) AS n, CASE WHEN regexp_matches(x, '\\p{{L}}') THEN lower(trim(regexp_replace(regexp_replace(x, '\\p{{Nd}}+', '0', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) ELSE trim(regexp_replace(x, '{gap}+', ' ', 'g')) END AS line
    FROM (SELECT doc_id, host, unnest(lines) AS x FROM w)),
hosts AS (SELECT host, count(*) AS n FROM w GROUP BY host),
often AS (SELECT host, line, count(DISTINCT doc_id) AS n FROM each GROUP BY host, line),
frequent AS (SELECT o.host, o.line FROM often o JOIN hosts h ON h.host IS NOT DISTINCT FROM o.host WHERE o.n > {MAX_DOCS_PER_HOST} AND o.n > {MAX_SHARE_OF_HOST} * h.n),
sums AS (SELECT doc_id, sum(n) AS line_chars, sum(CASE WHEN f.line IS NULL THEN 0 ELSE n END) AS removed_chars FROM each e LEFT JOIN frequent f ON f.line = e.line AND f.host IS NOT DISTINCT FROM e.host GROUP BY doc_id),
base AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, coalesce(line_chars, 0)::bigint AS line_chars, coalesce(removed_chars, 0)::bigint AS removed_chars FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN sums USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR line_chars - removed_chars < {LEAST_LEFT} * line_chars) AS kept, line_chars, removed_chars FROM base"""


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verdicts(docs).select(*COLUMNS, "line_chars", "removed_chars")
