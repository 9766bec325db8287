"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of documents; the last
returns the packed pieces. ``run`` writes each stage's result to the shared folder and reads it for the next.

Every stage takes any rows with the columns of documents and further ones, whatever their names (these go), and gives for

* nulls: a null text is judged as an empty one; a row without doc_id is kept unless its text is rejected or repeats one that stays
  (near-dedup); it neither loses passages nor counts as an earlier copy (substring dedup); other null columns stay as they are;
* empty and blank texts: a score like any other; copies of each other, so one stays; nothing to remove; clean; one piece of id 0;
* very long texts: read whole by every stage, by chunks, slabs or pieces; one text at a time has to fit in a task's memory;
* ties and repeated rows: quality judges each row by its text; near-dedup keeps one of rows with equal id and text, and of rows that share an
  id each by its own text; substring dedup and decontamination judge each row by its own text, and equal rows alike; packing gives each row its pieces;
* an empty table: passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.llm import packing, phrase_index, quality, similar, suffix_tree
from stepfield.llm.base import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network accepts."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, COLUMNS).filter(F.col("predicted") == 1).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash links and those it can't reach; 5-word shingles, similarity 0.8 or more): the one with the smallest id."""
    return similar.one_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document has; texts of which nothing is left go.

    A text that loses words is written again with single spaces; n_chars follows. Other texts stay as they are.
    """
    out = suffix_tree.kept_words(docs, COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("rest.text"))
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumn("new", text)
    n_chars = F.when(F.col("n_removed") > 0, F.length("new").cast("bigint")).otherwise(F.col("rest.n_chars"))
    return out.select("doc_id", F.col("new").alias("text"), "rest.lang", "rest.source", n_chars.alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark passages."""
    bad = phrase_index.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("d"), F.col("sig").alias("s"))
    own = docs.select(*COLUMNS).withColumn("sig", F.xxhash64("text"))
    return own.join(bad, own.doc_id.eqNullSafe(bad.d) & (own.sig == bad.s), "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Learned scores, hashing of shingles and the tokeniser have no SQL; tests compare the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
