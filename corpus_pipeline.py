"""The corpus pipeline: quality, language, near-duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and returns the rows that it keeps, all columns
included; the last returns packed pieces. Rows are judged by their own content, so repeated ids and nulls do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, harmonic_packing, language_crf, quality_gam, simhash
from tidemark.llm.shared import materialize, release, settle, table

LEAST_QUALITY = 0.7
LEAST_LANGUAGE = 0.5

#: SQL can't express fitted models, fingerprints or alignment; the tests hold the stages against plain Python instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, predicts label 1 for, at its own threshold."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("__tidemark_quality", quality_gam.quality_score(F.col("text"), model))
    return scored.where(F.col("__tidemark_quality") >= LEAST_QUALITY).drop("__tidemark_quality")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are, by mean marginal, at least half in one known language; ``und`` goes."""
    crf = language_crf.train(docs)
    found = docs.withColumn("__tidemark_language", language_crf.language(F.col("text"), crf))
    sure = (F.col("__tidemark_language.lang_pred") != language_crf.UNKNOWN) & (F.col("__tidemark_language.score") >= LEAST_LANGUAGE)
    return found.where(sure).drop("__tidemark_language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts that SimHash finds and whose five-word shingles are similar by 0.8 or more: that
    with the smallest id, one without an id only if no other has one; of several texts under that id, or copies that differ
    in other columns, the one of the least hash."""
    rest = [c for c, kind in docs.dtypes if "map<" not in kind]
    keyed = docs.withColumns({"__tidemark_text": F.xxhash64("text"), "__tidemark_row": F.xxhash64(*rest)})
    marks = simhash.similar_texts(keyed, "__tidemark_text", row_col="__tidemark_row")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("__tidemark_row").alias("row"))
    first = keyed.groupBy("__tidemark_text").agg(F.min(order).alias("first"))
    heads = first.join(marks, F.col("__tidemark_text") == F.col("key"), "left").groupBy(F.coalesce("root", "__tidemark_text")).agg(F.min("first").alias("first"))
    heads = heads.select(F.col("first.row").alias("__tidemark_head"))
    kept = keyed.join(heads, F.col("__tidemark_row") == F.col("__tidemark_head"), "left_semi").dropDuplicates(["__tidemark_row"])
    return kept.drop("__tidemark_text", "__tidemark_row")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of ``benchmark``; a document without an id is judged like any other. Items too short
    to align are everyday phrases within longer texts, so they count against documents of just their words."""
    keyed = docs.withColumn("__tidemark_key", F.xxhash64("doc_id", "text"))
    leaks = decontamination.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="__tidemark_key")
    leaks = leaks.where((F.col("item_words") >= decontamination.LEAST_WORDS) | (F.col("item_words") == F.col("doc_words")))
    bad = materialize(leaks.select(F.col("__tidemark_key").alias("__tidemark_bad")).distinct(), "leaks")
    return keyed.join(bad, F.col("__tidemark_key") == F.col("__tidemark_bad"), "left_anti").drop("__tidemark_key")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, one row per piece."""
    import public_tokenizers

    return harmonic_packing.digest(harmonic_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it; what a stage needed is then deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
