"""One query per operator, over the driver's tables.

The tables hold no images: documents stand for image files (text digest, source,
label quality), events for frames of a video per user, line items for boxes of an
order's image, embeddings for thumbnails, and parts for class names.  The operators
are the library's own; only the mapping is made here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import names, scores
from ..operators import dedup, matching, merge, metrics, quality, relational, sampling, temporal, tiling

RMSE = 0.1335


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ mappings


def _documents(spark, sf) -> DataFrame:
    """Image files: path, digest, source and split."""
    d = _t(spark, sf, "documents").where("doc_id is not null and text is not null")
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    return d.select("doc_id", F.format_string("%010d", "doc_id").alias("path"), F.md5(F.encode("text", "utf-8")).alias("digest"), F.coalesce("source", F.lit("none")).alias("source"), split.alias("split"))


def _labels(spark, sf) -> DataFrame:
    return _t(spark, sf, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def _catalog(spark, sf) -> DataFrame:
    return _documents(spark, sf).join(_labels(spark, sf), "doc_id", "left")


def _holdout(spark, sf) -> DataFrame:
    return _documents(spark, sf).where("source = 'src0'").select("digest")


def _disposed(spark, sf) -> DataFrame:
    rows = _catalog(spark, sf).where("source <> 'src0'").select("source", "path", "digest", (F.coalesce("quality", F.lit(0)) == 1).alias("positive"))
    return merge.dispose(rows, _holdout(spark, sf), max_per_source=200, neg_ratio=0.5, val_share=0.1, seed=7)


def _frames(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events").where("user_id is not null and ts is not null and event_id is not null and value is not null")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    rows = e.select(F.col("user_id").alias("video"), F.col("event_id").alias("idx"), "ts", "value", k.alias("k"))
    rows = temporal.neighbours(rows, ["video"], ["ts", "idx"], "value")
    motion = F.when(F.col("prev").isNull(), scores.NO_NEIGHBOUR).otherwise(F.abs(F.col("value") - F.col("prev")) / 97)
    return rows.select("video", "idx", "ts", "value", "prev", "next", motion.alias("motion"), (F.col("k") % 13 / 100).alias("conf"))


def _lines(spark, sf) -> DataFrame:
    li = _t(spark, sf, "lineitem").where("l_orderkey is not null and l_linenumber is not null")
    n = lambda c, m, a: ((F.col(c) % m).cast("double") + a)
    x, y = n("l_partkey", 480, 5), n("l_suppkey", 330, 8)
    w, h = n("l_partkey", 97, 12), n("l_suppkey", 89, 12)
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.withColumn("k", F.row_number().over(place)).select("l_orderkey", "k", "l_linenumber", "l_returnflag", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), "l_quantity", "l_discount", "l_partkey", "l_suppkey")


def _gt(spark, sf) -> DataFrame:
    c = F.col
    return _lines(spark, sf).select(c("l_orderkey").alias("image"), c("k"), geo.box(c("x"), c("y"), c("x") + c("w"), c("y") + c("h")).alias("box"))


def _preds(spark, sf) -> DataFrame:
    c = F.col
    dx, dy = (c("l_quantity").cast("int") % 9).cast("double"), ((c("l_quantity").cast("int") + c("l_linenumber")) % 7).cast("double")
    conf = ((c("l_partkey") * 7 + c("l_suppkey") * 3 + c("l_linenumber")) % 100).cast("double") / 100
    rows = _lines(spark, sf).where("l_quantity % 5 <> 0")
    return rows.select(c("l_orderkey").alias("image"), c("k"), geo.box(c("x") + dx, c("y") + dy, c("x") + c("w") + dx, c("y") + c("h") + dy).alias("box"), conf.alias("conf"))


def _images(spark, sf) -> DataFrame:
    rows = matching.per_image(_gt(spark, sf), _preds(spark, sf), ["image"])
    return rows.withColumn("source", F.concat(F.lit("s"), F.col("image") % 5))


def _vectors(spark, sf) -> DataFrame:
    return _t(spark, sf, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _label_lines(spark, sf) -> DataFrame:
    """Label lines, every kind of fault among them."""
    c = F.col
    cx, cy = (c("l_partkey") % 100).cast("double") / 100, (c("l_suppkey") % 100).cast("double") / 100
    w, h = (c("l_quantity") % 25).cast("double") / 50, (c("l_linenumber") % 5).cast("double") / 10
    good = F.format_string("0 %.6f %.6f %.6f %.6f", cx, cy, w, h)
    kind = c("l_partkey") % 11
    line = F.when(kind == 1, F.format_string("0 %.6f %.6f", cx, cy)).when(kind == 2, F.format_string("0.0 %.6f %.6f %.6f %.6f", cx, cy, w, h)).when(kind == 3, F.format_string("1 %.6f %.6f %.6f %.6f", cx, cy, w, h))
    line = line.when(kind == 4, F.format_string("0 1.2000 %.6f %.6f %.6f", cy, w, h)).otherwise(good)
    rows = _t(spark, sf, "lineitem").where("l_orderkey is not null and l_linenumber is not null and l_partkey is not null and l_suppkey is not null and l_quantity is not null")
    split = F.when(c("l_orderkey") % 10 < 8, "train").when(c("l_orderkey") % 10 == 8, "val").otherwise("test")
    return rows.select(split.alias("split"), c("l_orderkey").cast("string").alias("stem"), c("l_linenumber").alias("line_no"), line.alias("line"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


# ------------------------------------------------------------------- queries


def alg10_leak_safe_merge(spark, sf):
    return _disposed(spark, sf).groupBy("source", "disposition").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def alg10_dispositions(spark, sf):
    return _disposed(spark, sf).select("source", "path", "disposition")


def agg18_merge_stats(spark, sf):
    return merge.merge_stats(_disposed(spark, sf))


def jn3_leaks(spark, sf):
    rows = _documents(spark, sf).where("source <> 'src0'")
    return rows.join(_holdout(spark, sf).distinct(), "digest", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("leaked"))


def set4_difference(spark, sf):
    rows = _documents(spark, sf).where("source <> 'src0'")
    return rows.join(_holdout(spark, sf).distinct(), "digest", "left_anti").select("path")


def win5_first_per_digest(spark, sf):
    return sampling.first_per_digest(_documents(spark, sf).select("digest", "source", "path"), "digest", ["source", "path"])


def alg13_validation_report(spark, sf):
    lines = _label_lines(spark, sf).select("split", "stem", "line")
    orders = _t(spark, sf, "orders").where("o_orderkey is not null").select(F.col("o_orderkey").alias("k"))
    split = F.when(F.col("k") % 10 < 8, "train").when(F.col("k") % 10 == 8, "val").otherwise("test")
    images = orders.select(split.alias("split"), F.col("k").cast("string").alias("stem"), (F.col("k") % 17 != 0).alias("label_present"))
    return quality.validation_report(images, lines.where("cast(stem as bigint) % 17 <> 0"))


def flt1_line_errors(spark, sf):
    e = _label_lines(spark, sf).withColumn("error", quality.line_error(F.col("line")))
    return e.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def flt2_out_of_bounds(spark, sf):
    c = F.col
    rows = _label_lines(spark, sf).withColumn("moved", quality.moved(c("cx"), c("cy"), c("w"), c("h")))
    return rows.groupBy("split").agg(F.count_if("moved").alias("moved"), F.count(F.lit(1)).alias("lines"))


def alg12_label_repair(spark, sf):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    texts = _label_lines(spark, sf).groupBy("stem").agg(lines.alias("text"))
    return quality.repair_labels(texts, ["stem"])


def agg3_box_extent(spark, sf):
    e = quality.box_extent(_label_lines(spark, sf), 0.1)
    return e.select(*(F.round(c, 6).alias(c) for c in e.columns))


def agg4_duplicate_groups(spark, sf):
    return quality.duplicate_groups(_documents(spark, sf))


def jn1_image_labels(spark, sf):
    state = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "positive").otherwise("negative")
    return _catalog(spark, sf).groupBy("split", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def jn2_orphan_labels(spark, sf):
    docs = _documents(spark, sf).where("doc_id % 3 <> 0").select(F.lit("a").alias("split"), F.col("doc_id").alias("stem"))
    labels = _labels(spark, sf).select(F.lit("a").alias("split"), F.col("doc_id").alias("stem"))
    return quality.orphan_labels(labels, docs).select("stem")


def agg7_split_counts(spark, sf):
    return relational.split_counts(_catalog(spark, sf).withColumn("boxes", F.coalesce("quality", F.lit(0)).cast("bigint")))


def jn10_negative_quota(spark, sf):
    return relational.negative_quota(_catalog(spark, sf).withColumn("positive", F.coalesce("quality", F.lit(0)) == 1), 100)


def jn4_move_plan(spark, sf):
    frames = _documents(spark, sf).select(F.col("source").alias("video"), "split", "path")
    moves = frames.groupBy("video").agg(F.when(F.substring(F.md5(F.encode("video", "utf-8")), 1, 1) < "8", "train").otherwise("test").alias("split"))
    return relational.move_counts(relational.move_plan(frames, moves))


def flt7_not_yet_labelled(spark, sf):
    return relational.not_yet(_documents(spark, sf), _labels(spark, sf), ["doc_id"]).select("doc_id")


def srt2_seeded_fraction(spark, sf):
    return sampling.fraction(_documents(spark, sf), ["split"], "path", 0.25, seed=3).select("split", "path")


def srt3_seeded_first(spark, sf):
    return sampling.first_n(_documents(spark, sf), "path", 25, seed=5).select("path")


def alg8_video_split(spark, sf):
    return sampling.split_groups(_documents(spark, sf).select("source"), "source")


def prj_names(spark, sf):
    d = _t(spark, sf, "documents").where("doc_id is not null")
    c = F.col
    name = F.format_string("clip %s_frame%06d_jpg.rf.%s.jpg", c("source"), c("doc_id"), F.substring(F.md5(c("doc_id").cast("string").cast("binary")), 1, 8))
    frame = F.format_string("v%s_frame%06d", c("source"), c("doc_id"))
    odd = F.when(c("doc_id") % 7 == 0, F.format_string("still%d", c("doc_id"))).otherwise(frame)
    out = names.output_name(c("source"), name, c("doc_id") % 2 == 0)
    return d.select(
        "doc_id", names.source_stem(name).alias("stem"), names.frame_video(odd).alias("video"), names.frame_index(odd).alias("idx"), out.alias("out_name"),
        names.source_of_name(out).alias("source_of"), names.safe_video_name(name).alias("safe"),
    )


def prj6_class_filter(spark, sf):
    p = _t(spark, sf, "part").where("p_partkey is not null")
    words = F.array(*(F.lit(w) for w in ("drone", " UAV ", "Anti-Drone", "bird", "flying drone", "helicopter", "Small_UAV", "drones2")))
    name = F.get(words, (F.col("p_partkey") % 8).cast("int"))
    return p.select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("target", names.is_target(F.col("name")))


def prj22_sampling_step(spark, sf):
    fps = F.when(F.col("p_size") % 9 == 0, F.lit(None).cast("double")).when(F.col("p_size") % 9 == 1, 0.0).otherwise(F.col("p_size") * 1.25)
    return _t(spark, sf, "part").select("p_size", names.sampling_step(fps).alias("step")).distinct()


def prj_box_conversions(spark, sf):
    c = F.col
    r, i = geo.repaired(c("cx"), c("cy"), c("w"), c("h")), geo.ingested(c("cx"), c("cy"), c("w"), c("h"))
    p = geo.to_pixels(c("cx"), c("cy"), c("w"), c("h"), F.lit(640.0), F.lit(480.0))
    back = geo.from_pixels(p["x1"], p["y1"], p["x2"], p["y2"], F.lit(640.0), F.lit(480.0))
    six = lambda x: F.round(x, 6)
    return _label_lines(spark, sf).select(
        "stem", "line_no", six(r["cx"]).alias("rep_cx"), six(r["w"]).alias("rep_w"), i.isNotNull().alias("usable"), six(p["x1"]).alias("px1"), six(p["y2"]).alias("py2"), six(back["w"]).alias("back_w"), six(back["cy"]).alias("back_cy")
    )


def prj13_size_bands(spark, sf):
    return _gt(spark, sf).groupBy(geo.size_band(metrics.area(F.col("box"))).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def prj14_tile_origins(spark, sf):
    images = _t(spark, sf, "part").select((F.col("p_size") * 40 + 200).alias("width"), (F.col("p_size") * 23 + 200).alias("height")).distinct().withColumn("image", F.lit("x"))
    return tiling.tiles(images, 640, 0.25).select("width", "height", "tile", "x", "y")


def prj15_grid_tiles(spark, sf):
    sizes = _t(spark, sf, "part").select((F.col("p_size") * 40 + 200).alias("width"), (F.col("p_size") * 23 + 200).alias("height")).distinct()
    return sizes.select("width", "height", F.posexplode(geo.grid_tiles(F.col("width"), F.col("height"))).alias("tile", "b")).select("width", "height", "tile", "b.*")


def prj_scores(spark, sf):
    c = F.col
    fill, aspect, changed = c("l_discount") * 8, (c("l_linenumber") % 5) / 5, c("l_tax") * 5
    area = c("l_quantity") * 500
    rows = _t(spark, sf, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(scores.motion_score(fill, aspect, changed), 6).alias("motion"), F.round(scores.proposal_score(area, fill, aspect), 4).alias("proposal"),
        F.round(scores.frame_score(F.when(c("l_linenumber") > 1, fill), c("l_quantity")), 6).alias("frame"), scores.blob_usable(area, changed).alias("usable"),
    )


def alg1_greedy_match(spark, sf):
    return matching.greedy_match(_images(spark, sf), 0.25).select("image", "n_gt", "n_pred", "hits", "fp")


def alg2_best_overlap(spark, sf):
    best = matching.best_overlap(_gt(spark, sf), _preds(spark, sf), ["image"])
    return best.select("image", "k", F.round("best_iou", 6).alias("best_iou"))


def agg8_recall_report(spark, sf):
    r = metrics.recall_report(matching.best_overlap(_gt(spark, sf), _preds(spark, sf), ["image"]))
    return r.select("band", "gt", "hits", F.round("recall", 6).alias("recall"), F.round("mean_iou", 6).alias("mean_iou"))


def agg9_by_source(spark, sf):
    r = metrics.by_group(matching.greedy_match(_images(spark, sf), 0.25), "source")
    return r.select("source", "imgs", "gt", "hit", "fp", F.round("recall", 6).alias("recall"), F.round("fp_per_img", 6).alias("fp_per_img"))


def agg10_by_size(spark, sf):
    r = metrics.by_size(matching.greedy_match(_images(spark, sf), 0.25))
    return r.select("band", "gt", "hits", F.round("recall", 6).alias("recall"))


def _swept(spark, sf):
    r = metrics.sweep(_images(spark, sf))
    return r.select("threshold", "n_gt", "hits", "fp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def agg12_threshold_sweep(spark, sf):
    return _swept(spark, sf)


def agg13_best_threshold(spark, sf):
    return metrics.best_threshold(_swept(spark, sf)).select("threshold", "f1")


def alg14_failure_report(spark, sf):
    """The threshold is chosen on val images (even sources), applied to test images (odd ones)."""
    images = _images(spark, sf)
    best = metrics.best_threshold(metrics.sweep(images.where("image % 2 = 0")))
    test = images.where("image % 2 = 1").join(F.broadcast(best.select("threshold")), F.lit(True))  # one row
    return metrics.by_group(matching.greedy_match(test, F.col("threshold")), "threshold").select("threshold", "imgs", "gt", "hit", "fp")


def srt7_first_misses(spark, sf):
    m = matching.greedy_match(_images(spark, sf), 0.25).select("image", F.explode("matches").alias("m")).where("m.pred is null")
    return m.select("image", F.col("m.k").alias("k")).orderBy("image", "k").limit(12)


def agg14_best_run(spark, sf):
    runs = _t(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.round(F.col("s_acctbal"), 0).alias("score"), F.col("s_suppkey").alias("seq"))
    return relational.best_run(runs)


def agg2_dimensions(spark, sf):
    return relational.dimensions(_t(spark, sf, "part").select((F.col("p_size") % 7).alias("width"), (F.col("p_size") % 5).alias("height")))


def alg3_nms(spark, sf):
    d = _preds(spark, sf).withColumn("image", F.floor(F.col("image") / 8))
    d = d.withColumn("k", (F.col("k") + F.floor(F.col("box.x1")) * 10 + F.floor(F.col("box.y1")) * 10000).cast("int"))
    d = d.groupBy("image", "k").agg(F.min(F.struct("box", "conf")).alias("s")).select("image", "k", "s.*")
    kept = d.groupBy("image").agg(F.collect_list(F.struct("k", "box", "conf")).alias("b")).select("image", F.explode(matching.suppress(F.col("b"), 0.1)).alias("b"))
    return kept.select("image", "b.k", "b.conf")


def alg18_proxy_scores(spark, sf):
    c = F.col
    label = F.get(F.array(*(F.lit(x) for x in ("bird", "car", "kite", "person", "boat"))), (c("l_suppkey") % 5).cast("int"))
    p = _t(spark, sf, "lineitem").where("l_orderkey is not null").select(c("l_orderkey").alias("image"), c("l_linenumber").alias("tile"), (c("l_partkey") % 1000).cast("int").alias("k"), (c("l_quantity") % 10 / 10).alias("conf"), label.alias("label"))
    return tiling.proxy_scores(p)


def jn7_similar_pairs(spark, sf):
    return dedup.similar_pairs(_vectors(spark, sf), RMSE)


def alg4_clusters(spark, sf):
    v = _vectors(spark, sf)
    return dedup.components(v, dedup.similar_pairs(v, RMSE)).select("id", "cluster")


def alg6_assign_splits(spark, sf):
    sizes = _documents(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("size")).select(F.col("source").alias("cluster"), "size")
    return dedup.assign_splits(sizes)


def alg5_units(spark, sf):
    rows = _documents(spark, sf).select(F.col("source").alias("parent"), (F.col("doc_id") % 97).alias("source_stem"), "path")
    return dedup.units(rows)


def agg5_copies_histogram(spark, sf):
    return dedup.copies_histogram(alg5_units(spark, sf))


def srt6_largest_clusters(spark, sf):
    rows = _documents(spark, sf).groupBy("digest").agg(F.count(F.lit(1)).alias("size"))
    return rows.orderBy(F.desc("size"), "digest").limit(4)


def jn8_nearest(spark, sf):
    v = _vectors(spark, sf)
    near = dedup.nearest(v.where("id % 10 = 0"), v.where("id % 10 <> 0"))
    return near.select("id", F.round("distance", 6).alias("distance"))


def alg7_leak_audit(spark, sf):
    v = _vectors(spark, sf)
    s = dedup.leak_stats(dedup.nearest(v.where("id % 10 = 0"), v.where("id % 10 <> 0")), (0.14, 0.15, 0.16), digits=4)
    return s


def win1_neighbours(spark, sf):
    return _frames(spark, sf).select("video", "idx", F.round("prev", 6).alias("prev"), F.round("next", 6).alias("next"), F.round("motion", 6).alias("motion"))


def alg9_frame_filter(spark, sf):
    f = temporal.filter_frames(_frames(spark, sf).withColumn("motion", F.round("motion", 4)), ["video"], ["ts", "idx"])
    return f.select("video", "idx", "strong", "near", "verdict", "reason")


def agg6_verdict_counts(spark, sf):
    f = temporal.filter_frames(_frames(spark, sf).withColumn("motion", F.round("motion", 4)), ["video"], ["ts", "idx"])
    return relational.verdict_counts(f.withColumn("split", F.concat(F.lit("s"), F.col("video") % 3)))


def win3_every_step(spark, sf):
    return temporal.every_step(_frames(spark, sf), "idx", 6).select("idx")


def win4_top_share(spark, sf):
    f = _frames(spark, sf).withColumn("score", F.round("motion", 4)).withColumn("group", F.col("video") % 20)
    return sampling.top_share(f, "group", "score", "idx").select("group", "idx")


def win6_rolling_rate(spark, sf):
    rows = _t(spark, sf, "events").where("user_id is not null and event_id is not null and value is not null").select(F.col("user_id").alias("source"), F.col("event_id").alias("frame_no"), (F.abs("value") / 100 + 0.01).alias("seconds"))
    return rows.select("source", "frame_no", F.round(temporal.rolling_fps(rows, ["source"], ["frame_no"], "seconds"), 6).alias("fps"))


def win7_running_hit_rate(spark, sf):
    rows = _t(spark, sf, "events").where("user_id is not null and event_id is not null and value is not null").select(F.col("user_id").alias("source"), F.col("event_id").alias("frame_no"), (F.col("value") > 50).alias("hit"))
    return rows.select("source", "frame_no", F.round(temporal.running_hit_rate(["source"], ["frame_no"], "hit"), 6).alias("hit_rate"))


def win8_min_gap(spark, sf):
    rows = _t(spark, sf, "events").where("user_id is not null and event_id is not null").select(F.col("user_id").alias("source"), F.col("event_id").alias("frame_no"), (F.col("event_id") * 0.25).alias("t"))
    return temporal.min_gap(rows, ["source"], "t", "frame_no", 300.0).select("source", "frame_no")


def srt1_review_order(spark, sf):
    f = _frames(spark, sf).select("video", "idx", F.when(F.col("idx") % 5 != 0, F.round("conf", 4)).alias("score"))
    return f.select("video", "idx", F.coalesce("score", F.lit(99.0)).alias("score")).orderBy("score", "video", "idx")


def agg19_hit_rate(spark, sf):
    return _frames(spark, sf).agg(F.round(F.avg((F.col("conf") >= 0.05).cast("double")), 6).alias("hit_rate"), F.count(F.lit(1)).alias("frames"))


def snk5_frame_report(spark, sf):
    from ..sinks.writers import report_rows

    f = temporal.filter_frames(_frames(spark, sf).withColumn("motion", F.round("motion", 4)), ["video"], ["ts", "idx"])
    return report_rows(f.select(F.lit("train").alias("split"), F.col("idx").cast("string").alias("filename"), "verdict", "conf", "motion", "reason"))


def snk6_moves(spark, sf):
    from ..sinks.writers import apply_verdicts

    f = temporal.filter_frames(_frames(spark, sf).withColumn("motion", F.round("motion", 4)), ["video"], ["ts", "idx"])
    return apply_verdicts(f.withColumn("split", F.lit("train"))).groupBy("prior", "split").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k.split("_")[0].rstrip("0123456789") in ("alg", "agg", "jn", "set", "win", "flt", "srt", "prj", "snk") and f.__module__ == __name__}
