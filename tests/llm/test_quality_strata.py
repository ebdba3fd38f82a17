from pyspark.sql import functions as F


def test_documents_without_a_language_are_a_stratum(spark):
    from boxwright.llm.quality import apply_rules

    text = F.concat(F.lit("some plain words that never repeat here at all "), F.col("id").cast("string"), F.when(F.col("id") % 4 != 0, F.lit("")).otherwise(F.repeat(F.lit(" ###"), 6)))
    df = spark.range(16000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit(None).cast("string").alias("lang"))
    labels = df.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    kept = {x.quality: x.kept for x in apply_rules(df, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert kept[1] >= 0.98 and kept[0] == 0
