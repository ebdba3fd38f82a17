"""The leak-safe merge: external images join the local train set without touching its hold-outs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import draw, first_per_digest, ranked


def dispose(external: DataFrame, holdout: DataFrame, max_per_source: int | None = None, neg_ratio: float = 0.25, val_share: float = 0.0, seed: int | str = 0) -> DataFrame:
    """external (source, path, digest, positive) with a disposition.

    leak: in the hold-out; dup: a copy of an earlier (source, path); over_cap and
    dropped_neg: beyond the source's caps; val_ext and train: what is used.  Copies are
    settled before caps, so a capped image still suppresses its copies.
    """
    held = holdout.select("digest").distinct().withColumn("__leak", F.lit(True))
    rows = external.join(held, "digest", "left").withColumn("__leak", F.coalesce("__leak", F.lit(False)))
    fresh = rows.where(~F.col("__leak"))
    first = first_per_digest(fresh.select("digest", "source", "path"), "digest", ["source", "path"]).select("digest", F.col("source").alias("__s"), F.col("path").alias("__p"))
    rows = rows.join(first, "digest", "left")
    own = (F.col("source") == F.col("__s")) & (F.col("path") == F.col("__p"))
    rows = rows.withColumn("disposition", F.when(F.col("__leak"), "leak").when(~F.coalesce(own, F.lit(False)), "dup")).drop("__leak", "__s", "__p")
    usable = rows.where("disposition is null")
    counts = usable.groupBy("source").agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nn"))
    cap = F.col("np") if max_per_source is None else F.least(F.col("np"), F.lit(max_per_source))
    counts = counts.select("source", cap.alias("cap"), F.least(F.col("nn"), F.floor(cap * neg_ratio)).alias("neg_cap"))
    key = F.concat_ws("/", "source", "path")
    numbered = _ranked(usable.withColumn("__u", draw(seed, key)), ["source", "positive"], "r").join(counts, "source")
    numbered = numbered.withColumn("in", F.when(F.col("positive"), F.col("r") <= F.col("cap")).otherwise(F.col("r") <= F.col("neg_cap")))
    chosen = _ranked(numbered.where("in").withColumn("__u", draw(f"{seed}h", key)), ["source"], "h")
    held_out = F.col("h") <= F.floor((F.col("cap") + F.col("neg_cap")) * val_share)
    used = chosen.withColumn("disposition", F.when(held_out, "val_ext").otherwise("train"))
    cut = numbered.where(~F.col("in")).withColumn("disposition", F.when(F.col("positive"), "over_cap").otherwise("dropped_neg"))
    cols = rows.columns
    return rows.where("disposition is not null").unionByName(used.select(*cols)).unionByName(cut.select(*cols))


def _ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """The rank by __u in each group."""
    return ranked(df, by, F.substring("__u", 1, 2), [F.col("__u"), F.col("path")], name).drop("__u", "__n")


def merge_stats(disposed: DataFrame) -> DataFrame:
    """Counts by source."""
    used = F.col("disposition").isin("train", "val_ext")
    count = lambda c, n: F.count_if(c).alias(n)
    return disposed.groupBy("source").agg(
        count(used & F.col("positive"), "pos"), count(used & ~F.col("positive"), "neg"), *(count(F.col("disposition") == d, n) for d, n in (("leak", "leaked"), ("dup", "dup"), ("dropped_neg", "dropped_neg"), ("over_cap", "over_cap"), ("val_ext", "held")))
    )


def union_inputs(*inputs: DataFrame) -> DataFrame:
    """The rows of all inputs, one after the other; columns meet by name."""
    return reduce(DataFrame.unionByName, inputs)


def held_digests(*splits: DataFrame) -> DataFrame:
    """The distinct digests of held-out splits."""
    return union_inputs(*(s.select("digest") for s in splits)).distinct()
