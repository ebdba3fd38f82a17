"""Sharding by a weighted k-d tree over document metadata.

Points are split again and again at the weighted median of the dimension that is
widest (its extent in the node against its extent in all), until a node is one
shard; a node of k shards is cut at floor(k/2)/k of its bytes, so any number of
shards comes out near equal.  The median is found by refining histograms: each pass
is one aggregate for all nodes of a level, and only bin totals reach the driver
(shards x bins rows at most).  Ties in a dimension are cut by a hash, so one value
may hold any part of the bytes.

A point is a group of equal texts, which stays in one shard unless it outweighs
``HEAVY`` of a shard; such groups are few by arithmetic, and their documents are
points of their own.

Defined results: a null text has no bytes, so a size of 8 and the crc32 of nothing;
null metadata is a value of its own; repeated rows are rows of their own; an empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, written

#: Part of a shard that a group of equal texts may weigh and still stay together.
HEAVY = 0.02
BINS = 1024
#: Part of a shard that may be misplaced at a cut.
CLOSE = 0.001
DIMS = ("d0", "d1", "d2")
_OVERHEAD = 8


def ranks(docs: DataFrame) -> DataFrame:
    """(kind, x, rank): the sources and languages in order, null first, however long what they share at the start.

    Ranges of the distinct values are numbered inside, then offset by the ranges' totals.
    """
    value = lambda c: F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("x"))
    found = docs.select(F.explode(F.array(value("source"), value("lang"))).alias("z")).select("z.kind", "z.x").distinct()
    dealt = written(found.repartitionByRange("kind", "x").withColumn("part", F.spark_partition_id()), "values")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    first = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = Window.partitionBy("part").orderBy("kind", "x")
    numbered = dealt.withColumn("k", F.row_number().over(at)).join(first, "part")
    out = written(numbered.select("kind", "x", (F.col("k") + F.col("first")).cast("double").alias("rank")), "ranks")
    drop_written(dealt)
    return out


def measured(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the text's fingerprint g, and the three dimensions: ranks of source and language, and size."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("bigint") + _OVERHEAD
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.log2(size.cast("double")).alias("d2"),
    )
    for c, d in (("source", "d0"), ("lang", "d1")):
        own = ranked.where(F.col("kind") == c).select(F.col("x").alias("__x"), F.col("rank").alias(d))
        rows = rows.join(own, F.col(c).eqNullSafe(F.col("__x"))).drop("__x", c)
    return rows.select("doc_id", "size", "text_crc32", "g", *DIMS)


def _unit(*cols: Column) -> Column:
    """A hash in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


class _Cut:
    """The search for one node's cut: a value of the dimension, then a hash among its ties."""

    def __init__(self, dim: int, lo: float, hi: float, want: float, slack: float):
        self.dim, self.lo, self.hi, self.want, self.slack = dim, lo, hi, want, slack
        self.tie: float | None = None
        self.done: dict | None = None

    def refine(self, bins: list) -> None:
        """bins, in order: (bin, weight, least value, greatest value, least hash, greatest hash).

        The cut is put between two bins, at the nearer side of the one that holds the
        median, once that bin is light enough; else the search goes on inside it.
        """
        below, k = 0.0, 0
        while k < len(bins) - 1 and below + bins[k][1] < self.want:
            below += bins[k][1]
            k += 1
        _, w, lo, hi, hlo, hhi = bins[k]
        low, high = (lo, hi) if self.tie is None else (hlo, hhi)
        take = self.want - below >= w / 2
        if w <= self.slack or (self.tie is not None and low == high):
            if self.tie is None:  # all up to the bin's greatest value, or all below its least
                self.done = {"dim": self.dim, "x": high if take else low, "h": 2.0 if take else -1.0}
            else:
                self.done = {"dim": self.dim, "x": self.tie, "h": high if take else math.nextafter(low, -1.0)}
        elif self.tie is None and low == high:
            self.tie, self.lo, self.hi, self.want = low, hlo, hhi, self.want - below
        else:
            self.lo, self.hi, self.want = low, high, self.want - below


def _few(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of rows (one for each node of the tree) as a table to broadcast."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cells = [F.struct(*(F.lit(v).cast(t).alias(n) for n, t, v in zip(names, kinds, row, strict=True))) for row in rows]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*cells))))


def _along() -> Column:
    """The value of a point in its node's dimension."""
    return F.when(F.col("dim") == 0, F.col("d0")).when(F.col("dim") == 1, F.col("d1")).otherwise(F.col("d2"))


def grow_tree(points: DataFrame, shards: int) -> DataFrame:
    """Adds the leaf (0 to shards - 1) to points with columns d0, d1, d2, h and w.

    Each level is a table of one row a node, broadcast and joined by the node.
    """
    spark = points.sparkSession
    nodes = [(0, shards)]
    placed = points.withColumn("node", F.lit(0))
    root: dict[str, float] = {}
    total = 0.0
    while any(b - a > 1 for a, b in nodes):
        ends = (f(d).alias(f"{n}_{d}") for d in (*DIMS, "h") for n, f in (("lo", F.min), ("hi", F.max)))
        seen = {r.node: r for r in placed.groupBy("node").agg(F.sum("w").alias("w"), *ends).collect()}
        if not root:
            total = float(sum(r.w for r in seen.values()))
            root = {d: max((r[f"hi_{d}"] - r[f"lo_{d}"] for r in seen.values()), default=0.0) or 1.0 for d in DIMS}
        cuts: dict[int, _Cut] = {}
        for k, (a, b) in enumerate(nodes):
            if b - a > 1 and k in seen:
                r = seen[k]
                wide = max(DIMS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / root[d])
                cuts[k] = _Cut(DIMS.index(wide), r[f"lo_{wide}"], r[f"hi_{wide}"], float(r.w) * ((b - a) // 2) / (b - a), CLOSE * total / shards)
        while left := {k: c for k, c in cuts.items() if c.done is None}:
            sought = _few(spark, [(k, c.dim, c.tie, c.lo, c.hi) for k, c in left.items()], "node int, dim int, tie double, lo double, hi double")
            v = F.when(F.col("tie").isNull(), F.col("v")).otherwise(F.col("h"))
            width = (F.col("hi") - F.col("lo")) / BINS
            at = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((v - F.col("lo")) / width).cast("int"))).otherwise(0)
            inside = placed.join(sought, "node").withColumn("v", _along()).where((F.col("tie").isNull() | (F.col("v") == F.col("tie"))) & v.between(F.col("lo"), F.col("hi")))
            totals = [F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("h").alias("hlo"), F.max("h").alias("hhi")]
            rows = inside.groupBy("node", at.alias("bin")).agg(*totals).collect()
            for k, c in left.items():
                c.refine(sorted((r.bin, float(r.w), r.lo, r.hi, r.hlo, r.hhi) for r in rows if r.node == k))
        level, grown = [], []
        for k, (a, b) in enumerate(nodes):
            if k in cuts:
                mid, cut = a + (b - a) // 2, cuts[k].done
                level.append((k, cut["dim"], cut["x"], cut["h"], len(grown), len(grown) + 1))
                grown += [(a, mid), (mid, b)]
            else:
                level.append((k, 0, 0.0, 0.0, len(grown), len(grown)))
                grown.append((a, a + 1))
        nodes = grown
        v = _along()
        goes = (v < F.col("x")) | ((v == F.col("x")) & (F.col("h") <= F.col("tie")))
        cut_table = _few(spark, level, "node int, dim int, x double, tie double, l int, r int")
        placed = placed.join(cut_table, "node").select(*points.columns, F.when(goes, F.col("l")).otherwise(F.col("r")).alias("node"))
    leaves = _few(spark, [(k, a) for k, (a, _) in enumerate(nodes)], "node int, leaf int")
    return placed.join(leaves, "node").drop("node")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    ranked = ranks(docs)
    rows = written(measured(docs, ranked), "measured")
    key = ["g", "text_crc32", "size"]
    totals = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    target = (totals.b or 0) / shards
    groups = rows.groupBy(*key).agg(F.sum("size").alias("w"), *(F.min(d).alias(d) for d in DIMS))
    groups = written(groups, "groups")
    heavy = F.broadcast(groups.where(F.col("w") > HEAVY * target).select(*key))  # fewer than shards / HEAVY rows
    alone = rows.join(heavy, key, "left_semi").select("*", _unit(F.col("doc_id"), F.col("g")).alias("h"))
    points = groups.where(F.col("w") <= HEAVY * target).select(*key, *DIMS, "w", _unit(F.col("g"), F.col("text_crc32")).alias("h"), F.lit(False).alias("alone"))
    points = points.unionByName(alone.groupBy(*key, *DIMS, "h").agg(F.sum("size").alias("w")).withColumn("alone", F.lit(True)))
    points = written(points, "points")
    placed = written(grow_tree(points, shards).select(*key, "h", "alone", "d0", "d1", "leaf"), "leaves")
    together = rows.join(heavy, key, "left_anti").join(placed.where("not alone").select(*key, "leaf"), key)
    apart = alone.join(placed.where("alone").select(*key, "h", "d0", "d1", "leaf"), [*key, "h", "d0", "d1"]).select(*together.columns)
    out = together.unionByName(apart).select("doc_id", "size", "text_crc32", "g", F.col("leaf").alias("shard"))
    out = written(out, "sharded")
    drop_written(points, placed, groups, rows, ranked)
    return _slots(out, shards, totals.n).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _slots(rows: DataFrame, shards: int, n: int) -> DataFrame:
    """Gapless slots from 0 in each shard: numbered in hashed parts of bounded size, whose totals give each part its first slot."""
    parts = max(16, n // (shards * 250_000))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "g"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = Window.partitionBy("shard", "part").orderBy("doc_id", "g")
    return dealt.withColumn("k", F.row_number().over(at)).join(first, ["shard", "part"]).withColumn("slot", F.col("first") + F.col("k") - 1)
