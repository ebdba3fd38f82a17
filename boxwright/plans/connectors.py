"""Queries of readers, writers and streams: what is written is read back, streams run until all input is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, merge, metrics, temporal
from ..sinks import writers
from ..sinks.shared import shared_path
from ..sources import labels, reports
from ..streaming import counters
from . import queries as q


def _label_files(spark, sf) -> DataFrame:
    """The label files of all orders, as the readers give them: path, text."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    return q._label_lines(spark, sf).groupBy(F.concat(F.lit("labels/"), "stem", F.lit(".txt")).alias("path")).agg(lines.alias("text"))


def src2_label_states(spark, sf):
    return labels.yolo_boxes(_label_files(spark, sf), keep=[0]).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("box.w"), 4).alias("width"))


def _pictures(spark, sf) -> DataFrame:
    d = q._documents(spark, sf)
    return d.select(F.concat(F.col("source"), F.lit("/images/"), "path", F.lit(".jpg")).alias("path"), "digest", "doc_id", "source")


def _normalised(spark, sf) -> DataFrame:
    """Labelled documents have a text label, of the others every fourth is in its source's COCO file (every eighth with a box), every fifth has a VOC file."""
    pictures = _pictures(spark, sf)
    marks = q._labels(spark, sf)
    rows = pictures.join(marks, "doc_id", "left")
    text = rows.where("quality is not null").select(F.regexp_replace(F.regexp_replace("path", "/images/", "/labels/"), "jpg$", "txt").alias("path"), F.when(F.col("quality") == 1, "0 0.5 0.5 0.2 0.2\n1 0.5 0.5 0.1 0.1").otherwise("").alias("text"))
    rest = rows.where("quality is null")
    image = F.struct(F.col("doc_id").alias("id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"))
    note = F.when(F.col("doc_id") % 8 == 0, F.struct(F.col("doc_id").alias("image_id"), F.lit(7).alias("category_id"), F.array(*(F.lit(float(x)) for x in (10, 10, 20, 20))).alias("bbox")))
    files = rest.where("doc_id % 4 = 0").groupBy(F.concat("source", F.lit("/instances.json")).alias("path")).agg(F.collect_list(image).alias("images"), F.collect_list(note).alias("annotations"))
    names = F.array(F.struct(F.lit(7).alias("id"), F.lit("Drone").alias("name")))
    coco = labels.coco_boxes(files.select("path", F.to_json(F.struct("images", "annotations", names.alias("categories"))).alias("text")))
    xml = F.lit("<annotation><size><width>100</width><height>100</height></size><object><name>uav</name><bndbox><xmin>10</xmin><ymin>10</ymin><xmax>30</xmax><ymax>20</ymax></bndbox></object></annotation>")
    voc = labels.voc_boxes(rest.where("doc_id % 5 = 0").select(F.regexp_replace("path", "jpg$", "xml").alias("path"), xml.alias("text")))
    return labels.normalise(pictures.select("path", "digest"), text, coco, voc, keep=[0])


def alg11_normalised(spark, sf):
    out = _normalised(spark, sf)
    return out.groupBy(F.coalesce("origin", F.lit("none")).alias("origin"), "disposition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("boxes"), F.lit(0))).cast("bigint").alias("boxes"))


def agg17_accounting(spark, sf):
    a = labels.accounting(_normalised(spark, sf))
    return a.select(*(F.col(c).cast("bigint").alias(c) for c in a.columns))


def set2_union_of_inputs(spark, sf):
    d = q._documents(spark, sf)
    return merge.union_inputs(*(d.where(F.col("split") == s).select("split", "path") for s in ("train", "val", "test"))).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def set3_held_out_digests(spark, sf):
    d = q._documents(spark, sf)
    return merge.held_digests(d.where("split = 'val'"), d.where("split = 'test'"))


def agg11_recall_by_background(spark, sf):
    green = (F.col("image") % 10).cast("double") / 10
    r = metrics.by_background(matching.greedy_match(q._images(spark, sf), 0.25).withColumn("green", green))
    return r.select("background", "imgs", "gt", "hit", F.round("recall", 6).alias("recall"))


def snk1_manifest(spark, sf):
    at = shared_path(spark, "manifest")
    writers.write_manifest(q._documents(spark, sf).select("split", "path", "digest"), at)
    return spark.read.schema("path string, digest string, split string").parquet(at).select("split", "path", "digest")


def src10_report(spark, sf):
    """The frame report written as CSV and read again."""
    f = temporal.filter_frames(q._frames(spark, sf).withColumn("motion", F.round("motion", 4)), ["video"], ["ts", "idx"])
    at = shared_path(spark, "report")
    writers.write_report(f.select(F.lit("train").alias("split"), F.col("idx").cast("string").alias("filename"), "verdict", "conf", "motion", "reason"), at)
    return reports.read_report(spark, at)


def snk8_repair_with_backup(spark, sf):
    """Label files repaired in place after a copy: the copy holds what was there before."""
    at, copy = shared_path(spark, "labels"), shared_path(spark, "backup")
    _label_files(spark, sf).write.parquet(at)
    writers.rewrite_with_backup(spark, at, copy, lambda files: q.quality.repair_labels(files, ["path"]).select("path", "text"))
    kind = lambda path, name: spark.read.schema("path string, text string").parquet(path).select(F.lit(name).alias("kind"), "path", "text")
    return kind(copy, "before").unionByName(kind(at, "after"))


def _streamed(spark, sf, make, columns: dict) -> DataFrame:
    """A stateful operator over the events as a stream, each frame once; its appended rows are read back."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").where("user_id is not null and event_id is not null and value is not null")
    made = make(stream.select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("frame_no"), *(c.alias(n) for n, c in columns.items())))
    at = shared_path(spark, "stream")
    run = made.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/rows")


def str2_running_counters(spark, sf):
    got = _streamed(spark, sf, counters.running_counters, {"seconds": F.abs("value") / 100 + 0.01, "n": (F.col("value") > 50).cast("int")})
    return got.select(F.col("source").cast("bigint").alias("source"), "frame_no", "seen", "hit", F.round("hit_rate", 6).alias("hit_rate"), F.round("fps", 6).alias("fps"))


def str4_rate_limited(spark, sf):
    got = _streamed(spark, sf, lambda s: counters.rate_limited(s, 300.0, 5), {"t": F.col("event_id") * 0.25})
    return got.select(F.col("source").cast("bigint").alias("source"), "frame_no", "saved")


QUERIES = {f.__name__: f for f in (src2_label_states, alg11_normalised, agg17_accounting, set2_union_of_inputs, set3_held_out_digests, agg11_recall_by_background, snk1_manifest, src10_report, snk8_repair_with_backup, str2_running_counters, str4_rate_limited)}
