import random

import pytest
from pyspark.sql import functions as F

from boxwright.operators import dedup, matching, merge, metrics, quality, relational, sampling, temporal, tiling


def py_iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / u if u > 0 else 0.0


def boxes(rng, n):
    return [(x, y, x + rng.randint(2, 12), y + rng.randint(2, 12)) for x, y in ((rng.randint(0, 20), rng.randint(0, 20)) for _ in range(n))]


BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


@pytest.fixture(scope="module")
def scenes(spark):
    rng = random.Random(5)
    data = {i: (boxes(rng, rng.randint(0, 6)), [(b, round(rng.random(), 1)) for b in boxes(rng, rng.randint(0, 8))]) for i in range(120)}
    f = lambda b: tuple(float(x) for x in b)
    gt = spark.createDataFrame([(i, k, f(b)) for i, (g, _) in data.items() for k, b in enumerate(g)], f"image int, k int, box {BOX}")
    preds = spark.createDataFrame([(i, k, f(b), c) for i, (_, p) in data.items() for k, (b, c) in enumerate(p)], f"image int, k int, box {BOX}, conf double")
    return data, gt, preds


def test_greedy_match_equals_plain_python(scenes):
    data, gt, preds = scenes
    got = {r.image: (r.n_gt, r.hits, r.fp) for r in matching.greedy_match(matching.per_image(gt, preds, ["image"]), 0.3).collect()}
    for i, (g, p) in data.items():
        kept, used, hits = [(k, b) for k, (b, c) in enumerate(p) if c >= 0.3], set(), 0
        for b in g:
            best = max(((py_iou(b, q), -k) for k, q in kept if k not in used), default=(0, 0))
            if best[0] >= 0.5:
                used.add(-best[1])
                hits += 1
        if g or p:
            assert got[i] == (len(g), hits, len(kept) - len(used))


def test_exclusive_and_reusable_recall_differ(spark):
    b = (0.0, 0.0, 10.0, 10.0)
    gt = spark.createDataFrame([(1, 0, b), (1, 1, b)], f"image int, k int, box {BOX}")
    preds = spark.createDataFrame([(1, 0, b, 0.9)], f"image int, k int, box {BOX}, conf double")
    m = matching.greedy_match(matching.per_image(gt, preds, ["image"])).first()
    assert (m.hits, m.fp) == (1, 0)
    assert metrics.recall_report(matching.best_overlap(gt, preds, ["image"])).where("band = 'ALL'").first().hits == 2


def test_nms_equals_plain_python(scenes):
    data, _, preds = scenes
    got = {}
    rows = preds.groupBy("image").agg(F.collect_list(F.struct("k", "box", "conf")).alias("b"))
    for r in rows.select("image", F.transform(matching.suppress(F.col("b"), 0.3), lambda x: x["k"]).alias("ks")).collect():
        got[r.image] = r.ks
    for i, (_, p) in data.items():
        kept = []
        for k in sorted(range(len(p)), key=lambda k: (-p[k][1], k)):
            if all(py_iou(p[k][0], p[q][0]) < 0.3 for q in kept):
                kept.append(k)
        if p:
            assert got[i] == kept


def test_best_threshold_takes_first_of_equals(spark):
    swept = spark.createDataFrame([(0.2, 0.5), (0.1, 0.5), (0.3, 0.4)], "threshold double, f1 double")
    assert metrics.best_threshold(swept).first().threshold == 0.1


def test_line_errors(spark):
    want = {
        "0 0.5 0.5 0.2": "expected 5 fields, got 4", "0.0 0.5 0.5 0.2 0.2": "non-numeric field", "1 0.5 0.5 0.2 0.2": "class id 1, expected 0", "0 1.2 0.5 0.2 0.2": "center_x=1.2000 outside [0,1]",
        "0 0.5 0.5 0 0.2": "width/height must be > 0 (got 0.0000x0.2000)", "0 0.95 0.5 0.2 0.2": "box extends outside the image", "0 0.5 0.5 0.2 0.2": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "line string")
    assert {r.line: r.e for r in rows.select("line", quality.line_error(F.col("line")).alias("e")).collect()} == want


def test_repair_touches_only_bad_lines(spark):
    rows = spark.createDataFrame([("a", "0 0.95 0.5 0.2 0.2\n0  0.5 0.5 0.1 0.1\njunk"), ("b", "0 0.5 0.5 0.1 0.1")], "stem string, text string")
    got = {r.stem: (r.text, r.touched) for r in quality.repair_labels(rows, ["stem"]).collect()}
    assert got == {"a": ("0 0.925000 0.500000 0.150000 0.200000\n0  0.5 0.5 0.1 0.1\njunk", True), "b": ("0 0.5 0.5 0.1 0.1", False)}


def test_merge_adds_up_and_does_not_leak(spark):
    rng = random.Random(3)
    ext = spark.createDataFrame([(f"s{i % 3}", f"{i:04d}", f"d{rng.randint(0, 150)}", rng.random() < 0.6) for i in range(300)], "source string, path string, digest string, positive boolean")
    held = spark.createDataFrame([(f"d{i}",) for i in range(20)], "digest string")
    out = merge.dispose(ext, held, max_per_source=20, neg_ratio=0.5, val_share=0.2, seed=1).cache()
    assert out.count() == 300
    used = out.where("disposition in ('train', 'val_ext')")
    assert used.join(held, "digest", "left_semi").count() == 0
    assert used.count() == used.select("digest").distinct().count()
    for r in merge.merge_stats(out).collect():
        assert r.pos <= 20 and r.neg <= int(min(20, r.pos) * 0.5) and r.held == int((r.pos + r.neg) * 0.2)


@pytest.mark.parametrize(("n", "want"), [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (5, (3, 1, 1)), (8, (6, 1, 1)), (10, (7, 2, 1)), (15, (10, 2, 3))])
def test_video_split(spark, n, want):
    got = {r.split: r["count"] for r in sampling.split_groups(spark.range(n).select(F.col("id").cast("string").alias("v")), "v").groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


def test_assign_splits_by_hand(spark):
    sizes = spark.createDataFrame(list(enumerate([5, 3, 3, 2, 1, 1, 1, 1, 1, 2])), "cluster int, size int")
    rows = dedup.assign_splits(sizes).collect()
    total = {s: sum(r["size"] for r in rows if r.split == s) for s in ("val", "test", "train")}
    assert total == {"val": 5, "test": 3, "train": 12}
    assert {r.cluster: r.split for r in rows}[0] == "val" and {r.cluster: r.split for r in rows}[1] == "test"


def test_similar_pairs_and_clusters(spark):
    rng = random.Random(9)
    vecs = {i: [rng.random() for _ in range(16)] for i in range(60)}
    vecs |= {60 + i: [x + 0.01 for x in vecs[i]] for i in range(20)} | {80 + i: [x + 0.02 for x in vecs[i]] for i in range(10)}
    df = spark.createDataFrame([(i, v) for i, v in vecs.items()], "id int, v array<float>")
    near = lambda a, b, t: (sum((x - y) ** 2 for x, y in zip(vecs[a], vecs[b], strict=True)) / 16) ** 0.5 <= t
    pairs = {(r.a, r.b) for r in dedup.similar_pairs(df, 0.015).collect()}
    assert pairs == {(a, b) for a in vecs for b in vecs if a < b and near(a, b, 0.015)}
    label = {i: i for i in vecs}
    for _ in vecs:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.cluster for r in dedup.components(df, spark.createDataFrame(list(pairs), "a int, b int")).collect()} == label


def test_neighbour_guard(spark):
    df = spark.createDataFrame([(1, i, i == 0) for i in range(4)], "v int, i int, s boolean")
    got = [r.near for r in df.withColumn("near", temporal.near_strong(df, ["v"], ["i"], "s")).orderBy("i").collect()]
    assert got == [False, True, True, False]


@pytest.mark.parametrize(("n", "keep"), [(5, 5), (10, 10), (12, 10), (20, 15)])
def test_top_share(spark, n, keep):
    df = spark.createDataFrame([("v", i, float(i % 3)) for i in range(n)], "v string, i int, s double")
    assert sampling.top_share(df, "v", "s", "i").count() == keep


def test_min_gap_counts_from_the_last_taken(spark):
    df = spark.createDataFrame([("c", i, i * 0.1) for i in range(10)], "source string, k int, t double")
    assert sorted(r.k for r in temporal.min_gap(df, ["source"], "t", "k", 0.15).collect()) == [0, 2, 4, 6, 8]


def test_predict_tiled(spark):
    images = spark.createDataFrame([("a", 848, 480)], "image string, width int, height int")

    def detector(batches):
        import pandas as pd

        for b in batches:  # one object at (300, 100) in the frame, as each tile sees it
            yield pd.DataFrame([(r.image, r.tile, 0, 300.0 - r.x, 100.0 - r.y, 340.0 - r.x, 140.0 - r.y, 0.9 - 0.1 * r.tile) for r in b.itertuples()], columns=["image", "tile", "k", "x1", "y1", "x2", "y2", "conf"])

    got = tiling.predict_tiled(images, detector).collect()
    assert len(got) == 1 and tuple(got[0].box) == (300.0, 100.0, 340.0, 140.0) and got[0].conf == pytest.approx(1.0)


def test_relational(spark):
    frames = spark.createDataFrame([("v1", "train", 1), ("v1", "train", 2), ("v2", "val", 1)], "video string, split string, n int")
    moves = spark.createDataFrame([("v1", "test"), ("v2", "val")], "video string, split string")
    assert [(r.move, r.n) for r in relational.move_counts(relational.move_plan(frames, moves)).collect()] == [("train -> test", 2)]
    runs = spark.createDataFrame([("b", 0.5, 2), ("a", 0.5, 1), ("c", 0.4, 0)], "name string, score double, seq int")
    assert relational.best_run(runs).first().name == "a"
