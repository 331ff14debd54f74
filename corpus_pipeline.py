"""A corpus through five stages: classifier, rules, near-duplicates, personal data, packing.

Every stage is written as Parquet to the shared folder and read again by the next one.
The stages before the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayline.llm import packing, pii, quality_classifier, quality_rules, simhash
from wayline.plans.storage import load_table, materialize


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7 go.

    A null text is scored as an empty one; rows with a null id are scored but teach nothing;
    repeated rows have equal scores.
    """
    return quality_classifier.keep_good(docs, load_table(spark, sf_dir, "labels"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or that boilerplate lines make up, go; the others lose these lines.

    Rows of one text count as one document of their host, as the next stage keeps one of them.
    A null text has no words, so it goes; a null source is a source of its own; rows
    with a null id are told apart by their texts; repeated rows share their fate.
    """
    return _counted(quality_rules.keep_clean(docs, copies_count_once=True))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the smallest id (null ids last); rows that tie are told apart by a number.

    Null and wordless texts are one group; repeated rows leave one.
    """
    (uid,) = quality_rules.unused(docs, "uid")
    rows = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    groups = simhash.near_duplicate_groups(rows, id_col=uid).select(F.col("doc_id").alias("u"), "component_id")
    ids = rows.select(F.col(uid).alias("u"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(uid).alias("u")).alias("place"))
    kept = groups.join(ids, "u").groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.u").alias(uid))
    return rows.join(kept, uid, "left_semi").select(*docs.columns)


def pseudonymized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced; n_chars follows the new text.  A null text stays null; equal values have equal pseudonyms in all rows."""
    return _counted(pii.pseudonymize(docs, pii.configured_key(spark), found_col=None))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, in the sources' proportions.  A null text is empty and still ends in its end id."""
    import public_tokenizers

    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


STAGES = [
    ("quality classifier", good_quality),
    ("quality rules", clean_lines),
    ("SimHash near-dedup", one_of_each),
    ("PII", pseudonymized),
    ("packing", packed),
]
#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
