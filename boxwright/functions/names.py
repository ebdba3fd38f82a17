"""Names and classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types, name patterns and the class names that count as the one class.
IMAGE_TYPES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
FRAME = r"^(.+)_frame(\d+)$"
COPY_SUFFIX = r"_jpg\.rf\.[0-9a-f]+$"
TARGET_CLASSES = (
    r"(?i)^(anti[_ -]?)?(drone|drones|uav|uavs|quadcopter|quadrotor|multirotor"
    r"|multicopter|dron|flying[_ -]?drone|drone[_ -]?object|small[_ -]?uav"
    r"|suav|uav[_ -]?detection|drone[_ -]?detection)$"
)
NAME_LENGTH = 120


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(t.replace(".", r"\.") for t in IMAGE_TYPES) + ")$")


def frame_video(name: Column, otherwise_null: bool = False) -> Column:
    """The video of a frame name; other names are videos of their own (or null)."""
    return F.when(name.rlike(FRAME), F.regexp_extract(name, FRAME, 1)).otherwise(F.lit(None) if otherwise_null else name)


def frame_index(name: Column) -> Column:
    """The frame number, 0 where the name has none (or one that does not fit)."""
    return F.coalesce(F.when(name.rlike(FRAME), F.regexp_extract(name, FRAME, 2)).try_cast("bigint"), F.lit(0).cast("bigint"))


def source_stem(path: Column) -> Column:
    """The stem without the suffix that marks an augmented copy."""
    return F.regexp_replace(stem(path), COPY_SUFFIX, "")


def output_name(source: Column, name: Column, negative: Column) -> Column:
    """Where a file goes: source and name, unsafe characters replaced, cut to length, negatives marked."""
    plain = F.substring(F.regexp_replace(F.concat_ws("_", source, name), r"[^A-Za-z0-9_.-]", "_"), 1, NAME_LENGTH)
    return F.when(negative, F.concat(F.lit("neg_"), plain)).otherwise(plain)


def safe_video_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_.-]", "_")


def source_of_name(name: Column) -> Column:
    """The source that a name begins with: its first three parts, after the mark of a negative."""
    return F.substring_index(F.regexp_replace(name, "^neg_", ""), "_", 3)


def is_target(name: Column, pattern: str = TARGET_CLASSES) -> Column:
    return F.coalesce(F.trim(name).rlike(pattern), F.lit(False))


def sampling_step(fps: Column, per_second: int = 5) -> Column:
    """Frames from one sample to the next; an absent, zero or undefined rate counts as 30."""
    rate = F.coalesce(F.nullif(F.nanvl(fps, F.lit(None).cast("double")), F.lit(0.0)), F.lit(30.0))
    return F.greatest(F.lit(1), F.bround(rate / per_second).cast("int"))
