import pytest
from pyspark.sql import functions as F

from boxwright.functions import geometry as geo
from boxwright.functions import names, scores


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_tile_origins(spark):
    at = lambda w, h: [tuple(x) for x in one(spark, geo.tile_origins(F.lit(w), F.lit(h), 640, 0.25))[0]]
    assert at(848, 480) == [(0, 0), (208, 0)]
    assert at(640, 640) == [(0, 0)]
    assert len(at(1920, 1080)) == 8


def test_clamps(spark):
    lits = lambda *v: [F.lit(x) for x in v]
    r = one(spark, geo.repaired(*lits(0.95, 0.5, 0.2, 0.2)), geo.repaired(*lits(1.3, 0.5, 0.2, 0.2)), geo.ingested(*lits(1.3, 0.5, 0.2, 0.2)), geo.ingested(*lits(float("nan"), 0.5, 0.2, 0.2)))
    assert [round(x, 9) for x in r[0]] == [0.925, 0.5, 0.15, 0.2]
    assert round(r[1].w, 9) == -0.2
    assert r[2] is None and r[3] is None


def test_size_bands(spark):
    r = one(spark, *(geo.size_band(F.lit(float(a))) for a in (1023, 1024, 9215, 9216)))
    assert list(r) == ["small", "medium", "medium", "large"]


def test_iou(spark):
    b = lambda *v: geo.box(*(F.lit(float(x)) for x in v))
    r = one(spark, geo.iou(b(0, 0, 2, 1), b(1, 0, 3, 1)), geo.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)))
    assert r[0] == pytest.approx(1 / 3) and r[1] == 0.0


@pytest.mark.parametrize(("fps", "step"), [(30.0, 6), (None, 6), (0.0, 6), (float("nan"), 6), (12.5, 2), (1.0, 1), (60.0, 12)])
def test_sampling_step(spark, fps, step):
    assert one(spark, names.sampling_step(F.lit(fps).cast("double")))[0] == step


def test_names(spark):
    r = one(
        spark, names.frame_video(F.lit("a_frame000012")), names.frame_index(F.lit("a_frame000012")), names.frame_video(F.lit("still")), names.frame_index(F.lit("still")),
        names.source_stem(F.lit("d/x_jpg.rf.0a1b.jpg")), names.source_of_name(F.lit("neg_a_b_c_d")), names.safe_video_name(F.lit("é a/b")), names.is_target(F.lit(" Flying-Drone ")), names.is_target(F.lit("bird")),
    )
    assert list(r) == ["a", 12, "still", 0, "x", "a_b_c", "é_a_b", True, False]


def test_verdicts(spark):
    rows = [(0.2, 0.0, False, "keep"), (0.0, 2.0, False, "keep"), (0.05, 0.0, False, "review"), (0.0, 0.4, False, "review"), (0.0, 0.0, True, "review"), (0.0, 0.0, False, "removed"), (-1.0, 1.5, False, "review")]
    df = spark.createDataFrame(rows, "c double, m double, n boolean, want string")
    assert df.where(scores.verdict(F.col("c"), F.col("m"), F.col("n")) != F.col("want")).count() == 0
