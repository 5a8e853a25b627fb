"""A pipeline over the table of documents: what is bad, copied, repeated or leaked goes, the rest is mixed.

Every stage takes (spark, docs, directory of the tables) and returns a DataFrame. Between the stages
the rows are written as Parquet and read again. All stages but the last keep the columns of docs; columns whose names the
operators use themselves stay as they are. An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uptake.llm import leaks, mixing, near_duplicates, quality, queries, repeats
from uptake.llm.chunks import recorded, remove, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.7.

    NULL and empty texts have the score of an empty text; without labels of both classes every score is the share of
    good ones. Rows without doc_id and repeated rows are scored like all others; a score of exactly 0.7 stays.
    """
    return quality.good_documents(docs, queries.quality_labels(spark, sf_dir), least=0.7)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest doc_id.

    NULL and empty texts are nobody's duplicates. Rows without doc_id take no part and stay. Of rows that repeat both
    doc_id and text one stays; rows that share a doc_id alone are one document and stay or go together. Texts with fewer than five words are equal only
    as a whole.
    """
    classes = near_duplicates.near_duplicates(docs, size=5, threshold=0.8)
    names = [f"`{c}`" for c in docs.columns]
    kept = docs.join(classes.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*names)
    repeated = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").select(*names).dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(*names).unionByName(again)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words that start earlier elsewhere; emptied rows go, and n_chars follows the text.

    NULL, empty and short texts stay as they are. A NULL doc_id comes before all others. Rows that share a doc_id
    are one document: of equal passages at the same place in them neither is earlier.
    """
    cut = repeats.without_repeats(docs, length=20)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, whole or edited.

    NULL and empty texts hold none. Every row is judged by its own text, with or without a doc_id, repeated or not;
    a score of exactly the threshold counts as a leak. Without items all rows stay.
    """
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its copies say, numbered from 1 in the column ``copy``: the rows
    mix the languages to their targets. Documents with no copies go.

    NULL and empty texts have no words and the posterior of an empty text. Rows without doc_id and repeated rows are
    documents of their own; rows equal in doc_id and text get equal rates and copies. The columns n_tokens, posterior, rate, copies and copy
    are the stage's own and replace others of these names. Without labels all domains are equally likely.
    """
    labelled = queries.labelled_domains(spark, sf_dir, docs)
    mixed = mixing.mix_to_targets(docs.drop("copy"), labelled, queries.LANGUAGES).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents. What a stage has written for itself, and its input, is deleted when its
    rows are written; the last stage's tables stay, since its rows are not computed yet."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with recorded() as made:
            after = written(stage(spark, docs, sf_dir))
        remove(spark, [*before, *made[:-1]])
        docs, before = after, made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
