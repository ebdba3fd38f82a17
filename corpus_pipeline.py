"""The corpus pipeline: five stages over ``documents``, each applying one operator's decisions to all that the stage before kept.

Every stage but the last returns the columns of its input; ``run`` writes each
stage's rows to the shared folder and reads them again.  Nothing is swallowed: a
stage that fails fails the run.

In every stage an empty table gives an empty table, and columns beside those of
``documents`` pass through; they may have any names but ``__k`` (and, in the first
stage, those with the prefix it gives its input's columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm.common import drop_written, scratch_path, table, written

#: A language that is less sure is rejected, like no language at all.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without an identifiable language: null and letterless texts, and scores under LEAST_SCORE.  Null ids and languages do no harm; repeated rows are judged alike and all stay; ties go to the first language by name."""
    import public_tokenizers

    from boxwright.llm.langid import held_out, learn, predict

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    langs, probs = learn(docs, vocabulary, usable=~held_out(F.col("doc_id")))
    found = predict(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c != "text"}), langs, probs, vocabulary)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("text" if c == "text" else f"`in_{c}`").alias(c) for c in docs.columns))


def identity(docs: DataFrame) -> DataFrame:
    """docs with ``__k``, a 64-bit fingerprint of id and text: it names a row where ids are null or repeated, and equal rows share it."""
    return docs.withColumn("__k", F.xxhash64("doc_id", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest id (of equal ids, of the smallest fingerprint); a row without an id is kept only where its group has no id.  Of rows of one id and text one stays; texts without words are near to nothing."""
    from boxwright.llm.jaccard import join

    rows = written(identity(docs).dropDuplicates(["__k"]), "distinct")
    found = join(rows.select(F.col("__k").alias("doc_id"), "text")).select(F.col("doc_id").alias("__k"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__k")
    kept = rows.select("__k", "doc_id").join(found, "__k").groupBy("component_id").agg(F.min(order).alias("first")).select("first.__k")
    return rows.join(kept, "__k").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects contaminated rows, whatever their id; null and wordless texts and all rows where the benchmark is empty stay, and so do repeated rows that are clean."""
    from boxwright.llm.decontamination import decontaminate

    rows = identity(docs)
    found = decontaminate(rows.select(F.col("__k").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("__k")).distinct()
    return rows.join(found, "__k", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the target weights of sources, languages and topics; a null source or language is a value of its own, and repeated rows are sampled alike."""
    from boxwright.llm.mixing import sample

    return sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and reads them back: a row for each document, in ascending id order, nulls first; a null text has the end id alone."""
    import public_tokenizers

    from boxwright.llm.tokenstore import read_shards, write_shards

    manifest = write_shards(docs, scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: Segmentation sums, raking and tokenization can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(before)
        before = docs
    return docs
