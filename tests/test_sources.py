import json

from pyspark.sql import functions as F

from boxwright.sinks import writers
from boxwright.sources import labels, reports


def tree(root):
    (root / "a/images").mkdir(parents=True)
    (root / "a/labels").mkdir()
    for name in ("x", "y", "z", "copy"):
        (root / f"a/images/{name}.jpg").write_bytes(b"same" if name in ("z", "copy") else name.encode())
    (root / "a/labels/x.txt").write_text("0 0.5 0.5 0.2 0.2\n1 0.5 0.5 0.2 0.2\n0 0.1 0.1 0.3 0.1 0.3 0.3\nbad line\n0 nan 0.5 0.2 0.2 \n")
    (root / "a/labels/y.txt").write_text("")
    (root / "a/labels/z.txt").write_text("0 0.5 0.5 0.2 0.2")
    (root / "a/labels/copy.txt").write_text("0 0.5 0.5 0.2 0.2")
    (root / "b").mkdir()
    (root / "b/c.png").write_bytes(b"c")
    (root / "b/d.png").write_bytes(b"d")
    (root / "b/v.png").write_bytes(b"v")
    (root / "b/none.png").write_bytes(b"n")
    coco = {
        "images": [{"id": 1, "file_name": "p/c.png", "width": 100, "height": 50}, {"id": 2, "file_name": "d.png", "width": 10, "height": 10}],
        "annotations": [{"image_id": 1, "category_id": 7, "bbox": [10, 10, 20, 20]}, {"image_id": 1, "category_id": 8, "bbox": [0, 0, 5, 5]}],
        "categories": [{"id": 7, "name": "Drone"}, {"id": 8, "name": "bird"}],
    }
    (root / "b/instances.json").write_text(json.dumps(coco))
    obj = "<object><name>{}</name><bndbox><xmin>10</xmin><ymin>10</ymin><xmax>30</xmax><ymax>20</ymax></bndbox></object>"
    (root / "b/v.xml").write_text(f"<annotation><size><width>100</width><height>100</height></size>{obj.format('uav')}{obj.format('bird')}</annotation>")


def test_any_layout_to_one_class(spark, tmp_path):
    tree(tmp_path)
    pictures = labels.images(spark, str(tmp_path), content=True).drop("content")
    texts = labels.texts(spark, str(tmp_path))
    pictures = pictures.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    texts = texts.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    clean = lambda d: d.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    coco = labels.coco_boxes(clean(labels.texts(spark, str(tmp_path), "*.json")))
    voc = labels.voc_boxes(clean(labels.texts(spark, str(tmp_path), "*.xml")))
    out = labels.normalise(pictures, texts, coco, voc, keep=[0]).cache()
    got = {r.path.rsplit("/", 1)[1]: (r.origin, r.disposition, len(r.boxes or []), r.n_dropped) for r in out.collect()}
    assert got == {
        "x.jpg": ("text", "positive", 2, 1), "y.jpg": ("text", "negative", 0, 0), "z.jpg": ("text", "dup", 1, 0), "copy.jpg": ("text", "positive", 1, 0), "c.png": ("coco", "positive", 1, 0),
        "d.png": ("coco", "negative", 0, 0), "v.png": ("voc", "positive", 1, 0), "none.png": (None, "unlabelled", 0, 0),
    }
    acc = labels.accounting(out).first()
    assert (acc.positives, acc.negatives, acc.boxes, acc.dropped, acc.bad, acc.dup) == (4, 2, 5, 1, 1, 1)
    assert labels.normalise(pictures, texts, coco, voc, keep=[0], limit=2).where("disposition in ('positive', 'negative')").count() == 2


def test_class_names():
    assert labels.class_names("names: [drone, bird]", "yaml") == {0: "drone", 1: "bird"}
    assert labels.class_names("names: {0: a, 2: UAV}", "yaml") == {0: "a", 2: "UAV"}
    assert labels.class_names("drone\n\nbird\n", "text") == {0: "drone", 2: "bird"}
    assert labels.target_classes({0: " Drone ", 1: "bird"}) == [0]
    assert labels.target_classes({}) is None


def test_reports_and_state(spark, tmp_path):
    (tmp_path / "r.csv").write_text("split,filename,verdict,yolo_conf,motion_score,reason\ntrain,a,keep,0.5,1,x\ntrain,b,keep,oops,1,x\ntrain,a,keep,0.7,1,x\n")
    assert [(r.filename, r.score) for r in reports.read_report(spark, str(tmp_path / "r.csv")).collect()] == [("a", 0.7)]
    assert reports.review_state(str(tmp_path / "no.json")) == {"marks": {}, "position": 0}
    (tmp_path / "s.json").write_text('{"marks": {"k": "keep"}, "position": 3}')
    assert reports.review_state(str(tmp_path / "s.json")) == {"marks": {"k": "keep"}, "position": 3}
    old = spark.createDataFrame([("s", "a", "keep"), ("s", "b", "keep")], "split string, name string, mark string")
    new = spark.createDataFrame([("s", "a", "remove")], "split string, name string, mark string")
    assert {r.name: r.mark for r in reports.merge_marks(old, new).collect()} == {"a": "remove", "b": "keep"}


def test_writers(spark, tmp_path):
    plan = spark.createDataFrame([("train", "a"), ("val", "b")], "split string, path string")
    writers.write_manifest(plan, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("split = 'val'").first().path == "b"
    boxes = spark.createDataFrame([("a", 1, (0.5, 0.5, 0.2, 0.2)), ("a", 0, (0.1, 0.1, 0.1, 0.1))], "stem string, line_no int, box struct<cx:double,cy:double,w:double,h:double>")
    assert writers.label_texts(boxes, ["stem"]).first().text == "0 0.100000 0.100000 0.100000 0.100000\n0 0.500000 0.500000 0.200000 0.200000"
    writers.write_json(plan.groupBy().count(), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"count": 2}
    for run in ("1", "2"):
        writers.append_audit(plan, str(tmp_path / "audit"), run)
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 4
    moved = writers.apply_verdicts(plan.withColumn("verdict", F.lit("removed")))
    assert {r.split for r in moved.collect()} == {"removed/train", "removed/val"}
    assert {r.split for r in writers.restore(moved).collect()} == {"train", "val"}
