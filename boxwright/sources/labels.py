"""Readers of annotation formats, as DataFrames of lines and boxes."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import ingested
from ..functions.names import TARGET_CLASSES, base_name, is_image, is_target, stem
from ..operators.quality import fields


def images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """All image files under a folder, any layout: path, name, stem, length, and digest if content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(is_image(F.col("path")))
    cols = [F.col("path"), base_name(F.col("path")).alias("name"), stem(F.col("path")).alias("stem"), "length"]
    return files.select(*cols, *([F.md5("content").alias("digest"), "content"] if content else []))


def texts(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(path, text) of all text files under a folder, empty ones too: an empty label is a negative, and Spark's readers pass over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    empty = spark.createDataFrame([(p, "") for p in _empty_files(spark, root, glob)], "path string, text string")
    return files.select("path", F.col("content").cast("string").alias("text")).unionByName(empty)


def _empty_files(spark: SparkSession, root: str, glob: str) -> list[str]:
    """The names of the empty files, from the folder's listing alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listed, out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0 and fnmatch(f.getPath().getName(), glob):
            out.append(f.getPath().toString())
    return out


def label_candidates(path: Column) -> Column:
    """Where an image's label may be, in order: beside it, under labels for each images in its path, or in ../labels."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    parts = F.split(bare, "/")
    swaps = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.element_at(parts, i) == "images"),
        lambda i: F.concat(F.array_join(F.transform(parts, lambda p, k: F.when(k == i - 1, "labels").otherwise(p)), "/"), F.lit(".txt")),
    )
    up = F.concat(F.regexp_replace(bare, r"[^/]*/[^/]*$", ""), F.lit("labels/"), F.substring_index(bare, "/", -1), F.lit(".txt"))
    return F.concat(F.array(F.concat(bare, F.lit(".txt"))), swaps, F.array(up))


def resolve_labels(pictures: DataFrame, labels: DataFrame, keep_missing: bool = True) -> DataFrame:
    """pictures (path) with label_path (null if there is none): the first candidate that exists."""
    tried = pictures.select("path", F.posexplode(label_candidates(F.col("path"))).alias("rank", "label_path"))
    found = tried.join(labels.select(F.col("path").alias("label_path")), "label_path").groupBy("path").agg(F.min_by("label_path", "rank").alias("label_path"))
    return pictures.join(found, "path", "left" if keep_missing else "inner")


def yolo_boxes(labels: DataFrame, keep: list[int] | None = None) -> DataFrame:
    """labels (path, text) to (path, line_no, cls, box, state): box, dropped (class), degenerate or malformed.

    Polygons become their bounding boxes; numbers may be written as floats.
    """
    lines = labels.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).withColumn("p", fields(F.col("line"))).where(F.size("p") > 0)
    nums = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x.try_cast("double"))
    rows = lines.withColumn("v", nums).withColumn("c", F.get("p", F.lit(0)).try_cast("double")).withColumn("cls", F.when(F.abs("c") < 1e9, F.col("c")).cast("int"))
    xs, ys = F.filter("v", lambda x, i: i % 2 == 0), F.filter("v", lambda x, i: i % 2 == 1)
    ends = [F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)]
    poly = F.size("p") > 5
    at = lambda i: F.get("v", F.lit(i))
    cx, cy = F.when(poly, (ends[0] + ends[1]) / 2).otherwise(at(0)), F.when(poly, (ends[2] + ends[3]) / 2).otherwise(at(1))
    w, h = F.when(poly, ends[1] - ends[0]).otherwise(at(2)), F.when(poly, ends[3] - ends[2]).otherwise(at(3))
    bad = (F.size("p") < 5) | F.col("cls").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x))
    rows = rows.withColumn("box", F.when(~bad, ingested(cx, cy, w, h)))
    wanted = F.lit(True) if keep is None else F.col("cls").isin(*keep)
    state = F.when(bad, "malformed").when(~wanted, "dropped").when(F.col("box").isNull(), "degenerate").otherwise("box")
    return rows.select("path", "line_no", "cls", F.when(wanted, F.col("box")).alias("box"), state.alias("state"))


COCO = "images array<struct<id:bigint,file_name:string,width:double,height:double>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"


def coco_boxes(docs: DataFrame, pattern: str = TARGET_CLASSES) -> DataFrame:
    """docs (path, text) of COCO JSON to (path, name, boxes): every image, also those without a box of the class."""
    d = docs.select("path", F.from_json("text", COCO).alias("d")).where("d.images is not null and d.annotations is not null").select("path", "d.*")
    ims = d.select("path", F.inline("images")).withColumn("name", base_name(F.col("file_name")))
    cats = d.select("path", F.inline("categories")).select("path", F.col("id").alias("category_id"), is_target(F.col("name"), pattern).alias("keep"))
    some = d.select("path", (F.coalesce(F.size("categories"), F.lit(0)) > 0).alias("named"))
    anns = d.select("path", F.inline("annotations")).where(F.size("bbox") == 4).join(some, "path").join(cats, ["path", "category_id"], "left")
    anns = anns.where(~F.col("named") | F.coalesce("keep", F.lit(False)))
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    big = anns.join(ims.select("path", F.col("id").alias("image_id"), "width", "height"), ["path", "image_id"]).where("width > 0 and height > 0")
    boxed = big.withColumn("box", ingested((x + w / 2) / F.col("width"), (y + h / 2) / F.col("height"), w / F.col("width"), h / F.col("height"))).where("box is not null")
    per = boxed.groupBy("path", "image_id").agg(F.array_sort(F.collect_list("box")).alias("boxes"))
    return ims.join(per, (ims["path"] == per["path"]) & (ims["id"] == per["image_id"]), "left").select(ims["path"], "name", F.coalesce("boxes", F.array()).alias("boxes"))


VOC = "size struct<width:double,height:double>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def voc_boxes(docs: DataFrame, pattern: str = TARGET_CLASSES) -> DataFrame:
    """docs (path, text) of VOC XML to (path, boxes); null boxes where the file is unusable."""
    d = docs.select("path", F.from_xml("text", VOC).alias("d"))
    W, H = F.col("d.size.width"), F.col("d.size.height")
    wanted = F.filter(F.coalesce("d.object", F.array()), lambda o: o["bndbox"].isNotNull() & ((F.trim(F.coalesce(o["name"], F.lit(""))) == "") | is_target(o["name"], pattern)))
    part = lambda o, k: F.coalesce(o["bndbox"][k], F.lit(0.0))

    def boxed(o: Column) -> Column:
        x1, x2, y1, y2 = part(o, "xmin"), part(o, "xmax"), part(o, "ymin"), part(o, "ymax")
        return ingested((x1 + x2) / 2 / W, (y1 + y2) / 2 / H, (x2 - x1) / W, (y2 - y1) / H)

    usable = F.coalesce((W > 0) & (H > 0), F.lit(False))
    return d.select("path", F.when(usable, F.filter(F.transform(wanted, boxed), lambda b: b.isNotNull())).alias("boxes"))


def class_names(text: str, kind: str) -> dict[int, str]:
    """The class map of a data.yaml (names as a list or a map) or of a file with a name a line."""
    if kind == "yaml":
        import yaml

        names = (yaml.safe_load(text) or {}).get("names") or {}
        return {int(k): str(v) for k, v in (names.items() if isinstance(names, dict) else enumerate(names))}
    return {i: line.strip() for i, line in enumerate(text.splitlines()) if line.strip()}


def target_classes(names: dict[int, str], pattern: str = TARGET_CLASSES) -> list[int] | None:
    """Ids of the target class; None (keep all) where there are no names."""
    import re

    return [k for k, v in names.items() if re.match(pattern, v.strip())] if names else None


def normalise(pictures: DataFrame, labels: DataFrame, coco: DataFrame, voc: DataFrame, keep: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """Any layout to one class: (path, digest, origin, boxes, n_dropped, disposition).

    A text label goes before COCO, COCO before VOC.  positive, negative, unlabelled or
    dup (a digest that an earlier usable path has); limit counts kept images only.
    """
    found = resolve_labels(pictures, labels)
    lines = yolo_boxes(labels, keep).groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("state") == "box", F.struct("line_no", "box")))).alias("b"), F.count_if(F.col("state") == "dropped").alias("n"))
    known = labels.select("path").join(lines, "path", "left").select(F.col("path").alias("label_path"), F.transform(F.coalesce("b", F.array()), lambda x: x["box"]).alias("y"), F.coalesce("n", F.lit(0)).alias("n"))
    by_name = coco.groupBy("name").agg(F.flatten(F.collect_list("boxes")).alias("c"))
    by_stem = voc.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("bare"), F.col("boxes").alias("x"))
    rows = found.join(known, "label_path", "left").withColumn("name", base_name(F.col("path"))).withColumn("bare", F.regexp_replace("path", r"\.[^./]*$", ""))
    rows = rows.join(by_name, "name", "left").join(by_stem, "bare", "left")
    rows = rows.withColumn("boxes", F.coalesce("y", "c", "x")).withColumn("origin", F.when(F.col("y").isNotNull(), "text").when(F.col("c").isNotNull(), "coco").when(F.col("x").isNotNull(), "voc"))
    usable = rows.where("boxes is not null")
    first = usable.groupBy("digest").agg(F.min("path").alias("first"))
    rows = rows.join(first, "digest", "left")
    state = F.when(F.col("boxes").isNull(), "unlabelled").when(F.col("path") != F.col("first"), "dup").when(F.size("boxes") > 0, "positive").otherwise("negative")
    out = rows.select("path", "digest", "origin", "boxes", F.coalesce("n", F.lit(0)).alias("n_dropped"), state.alias("disposition"))
    if limit is None:
        return out
    kept = out.where(F.col("disposition").isin("positive", "negative")).orderBy("path").limit(limit)
    return kept.unionByName(out.where(~F.col("disposition").isin("positive", "negative")))


def accounting(normalised: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("disposition") == s)
    return normalised.agg(n("positive").alias("positives"), n("negative").alias("negatives"), F.sum(F.when(F.col("disposition") == "positive", F.size("boxes")).otherwise(0)).alias("boxes"), F.sum("n_dropped").alias("dropped"), n("unlabelled").alias("bad"), n("dup").alias("dup"))
