"""Deterministic shuffles, caps and splits: every draw is a rank by md5 of seed and key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | str, key: Column) -> Column:
    """What a seeded shuffle sorts by."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def ranked(df: DataFrame, by: list[str], part: Column, order: list[Column], name: str) -> DataFrame:
    """df with the rank by ``order`` in each group (``name``) and the group's rows (``__n``), in two steps: ranks inside parts, then the parts' offsets.

    Parts rise with the order, so a group of any size is ranked by as many tasks as it
    has parts and only their counts meet.  A null group is a group.
    """
    parts = df.withColumn("__b", part)
    groups = [f"__g{i}" for i in range(len(by))]
    counts = parts.groupBy(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), F.col("__b").alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*groups)
    before = F.sum("__c").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*groups, "__p", F.coalesce(before, F.lit(0)).alias("__o"), F.sum("__c").over(whole).alias("__n"))
    inside = parts.withColumn("__i", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(g)) for c, g in zip([*by, "__b"], [*groups, "__p"], strict=True)))
    return inside.join(offsets, same).withColumn(name, F.col("__i") + F.col("__o")).select(*df.columns, name, "__n")


def shuffled(df: DataFrame, by: list[str], seed: int | str, key: str) -> DataFrame:
    """df ranked (``__r``) by a seeded shuffle in each group, in 256 parts."""
    drawn = ranked(df.withColumn("__u", draw(seed, F.col(key))), by, F.substring("__u", 1, 2), [F.col("__u"), F.col(key)], "__r")
    return drawn.drop("__u")


def fraction(df: DataFrame, by: list[str], key: str, share: float, seed: int | str = 0) -> DataFrame:
    """The first int(n * share) rows of each group's shuffle."""
    return shuffled(df, by, seed, key).where(F.col("__r") <= F.floor(F.col("__n") * share)).drop("__r", "__n")


def first_n(df: DataFrame, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """n rows of the shuffle, without ranking the rest."""
    return df.orderBy(draw(seed, F.col(key)), F.col(key)).limit(n)


def first_per_digest(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """The first row of each digest in the given order.

    A minimum over structs combines before the shuffle, so a digest with any number
    of copies costs a row a task.
    """
    cols = [c for c in df.columns if c not in order]
    return df.groupBy(F.col(digest).alias("__d")).agg(F.min(F.struct(*order, *cols)).alias("__m")).select(*(F.col(f"__m.{c}").alias(c) for c in df.columns))


def split_groups(groups: DataFrame, key: str, shares: tuple[float, float] = (0.7, 0.15), seed: int | str = 42) -> DataFrame:
    """(key, split) for whole groups, never rows: shuffled, then train, val and test by rank.

    With fewer than three groups there is no val; with more, test has at least one.
    """
    ranks = shuffled(groups.select(key).distinct(), [], seed, key).withColumnsRenamed({"__r": "r", "__n": "n"})
    train = F.greatest(F.lit(1), F.bround(F.col("n") * shares[0]).cast("int"))
    val = F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.bround(F.col("n") * shares[1]).cast("int"))).otherwise(0)
    ranks = ranks.withColumn("v", val).withColumn("t", F.when((F.col("n") - train - F.col("v") < 1) & (F.col("n") >= 3), F.col("n") - F.col("v") - 1).otherwise(train))
    return ranks.select(key, F.when(F.col("r") <= F.col("t"), "train").when(F.col("r") <= F.col("t") + F.col("v"), "val").otherwise("test").alias("split"))


def top_share(df: DataFrame, by: str, score: str, order: str, share: float = 0.75, floor: int = 10) -> DataFrame:
    """The best-scored share of each group (all of small groups), ranked in 256 parts of the group's range of scores; NaN comes first and null last."""
    real = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    ends = df.groupBy(F.col(by).alias("__k")).agg(F.min(real).alias("__lo"), F.max(real).alias("__hi"))
    rows = df.join(ends, F.col(by).eqNullSafe(F.col("__k")))
    fall = F.nanvl((F.col("__hi") - real) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)), F.lit(0.0))
    part = F.when(F.col(score).isNull(), 256).when(real.isNull(), -1).otherwise(F.coalesce(F.floor(fall * 255), F.lit(0)))
    ranks = ranked(rows, [by], part, [F.desc(score), F.col(order)], "__r")
    return ranks.where(F.col("__r") <= F.greatest(F.lit(floor), F.floor(F.col("__n") * share))).select(*df.columns)
