"""Near-duplicate clusters over feature vectors."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import shared_dir
from . import vectors


def similar_pairs(rows: DataFrame, threshold: float, key: str = "id", vec: str = "v") -> DataFrame:
    """(a, b), a < b, of vectors of one length at most threshold apart (RMSE).

    Cells of a grid over the projections are as wide as similar vectors can differ, so
    only neighbouring cells meet, each two once, in pairs of blocks; what they hold is
    compared by matrix products and checked exactly.  Where the projections tell
    nothing apart, all blocks meet.  Keys are unique; rows without one are in no pair.
    """
    known = vectors.sample(rows, key, vec)
    placed = vectors.projected(rows, key, vec, vectors.directions(known))
    slack = vectors.magnitude(placed)
    width = F.lit(threshold) * F.sqrt("n") * (1 + 1e-9) + F.lit(slack + 1e-300)
    cells = [f"c{i}" for i in range(vectors.DIRECTIONS)]
    place = ["n", *cells]
    placed = placed.select("k", "v", "n", *(F.floor(F.col(p) / width).cast("bigint").alias(c) for p, c in zip(vectors.AXES, cells, strict=True)))
    blocks, places = vectors.numbered(placed, place)
    around = [o for o in product((-1, 0, 1), repeat=len(cells)) if o >= (0,) * len(cells)]
    looks = F.explode(F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(o, cells, strict=True))) for o in around)))
    left = places.withColumn("o", looks).select(*(F.col(c).alias(f"{c}_l") for c in [*place, "blocks"]), F.col("n").alias("n_r"), *((F.col(c) + F.col(f"o.{c}")).alias(f"{c}_r") for c in cells))
    right = places.select(*(F.col(c).alias(f"{c}_r") for c in [*place, "blocks"]))
    own = reduce(lambda x, y: x & y, (F.col(f"{c}_l") == F.col(f"{c}_r") for c in cells))
    first = F.when(own, F.col("block_l")).otherwise(0)
    met = left.join(right, [f"{c}_r" for c in place]).withColumn("block_l", F.explode(F.sequence(F.lit(0), F.col("blocks_l") - 1)))
    met = met.withColumn("block_r", F.explode(F.sequence(first, F.col("blocks_r") - 1))).withColumn("same", own & (F.col("block_l") == F.col("block_r")))

    def compare(k, x, l, y):
        import pyarrow as pa

        for i, j in vectors.within(x, x if y is None else y, threshold, y is None):
            yield k.take(pa.array(i)), (k if l is None else l).take(pa.array(j))

    kind = rows.schema[key].dataType.simpleString()
    found = vectors.met(blocks, blocks, met, place, compare, f"x {kind}, y {kind}")
    return found.where("x < y or y < x").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(key, cluster): the least key reachable over edges (a, b).  Labels fall along edges and then through themselves, to a fixed point."""
    spark = nodes.sparkSession
    shared_dir(spark)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.select(F.col("a").alias("k")).distinct().withColumn("c", F.col("k")).checkpoint()
    while True:
        around = both.join(labels, both["b"] == labels["k"]).groupBy("a").agg(F.min("c").alias("m"))
        fell = labels.join(around, labels["k"] == around["a"]).select("k", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        through = fell.select(F.col("k").alias("j"), F.col("c").alias("cj"))
        new = fell.join(through, fell["c"] == through["j"]).select("k", F.col("cj").alias("c"), "was").checkpoint()
        labels = new.select("k", "c")
        if new.where("c <> was").isEmpty():
            break
    return nodes.select(F.col(key).alias("k")).distinct().join(labels, "k", "left").select(F.col("k").alias(key), F.coalesce("c", "k").alias("cluster"))


def units(images: DataFrame) -> DataFrame:
    """images (parent, stem_of_source, path) by unit, with the first path as representative and the number of copies."""
    return images.groupBy("parent", "source_stem").agg(F.min("path").alias("rep"), F.count(F.lit(1)).alias("copies"))


def nearest(test: DataFrame, train: DataFrame, vec: str = "v") -> DataFrame:
    """(id, distance) from each test row to the nearest train row of its length, null where there is none; ids are unique.

    The nearest of a bounded sample of the train rows bounds how far a test row must
    look.  Train rows lie in slices of the first projection; a test block meets the
    slices in its reach, of those the blocks that no projection rules out.
    """
    known = vectors.sample(train, "id", vec)
    axes = vectors.directions(known)
    cuts = {n: sorted({float(x) for x in (axes[n][:1] @ v.T)[0][:: vectors.SLICE]}) for n, v in known.items()}
    listed = F.create_map(*(x for n, c in cuts.items() for x in (F.lit(n), F.lit(c)))) if cuts else F.create_map().cast("map<int,array<double>>")
    slices = F.coalesce(listed[F.col("n")], F.array().cast("array<double>"))
    below = lambda at: F.size(F.filter(slices, lambda c: c <= at))
    of_train, of_test = (vectors.projected(d, "id", vec, axes, k).withColumn("slice", below(F.col("p0"))) for d, k in ((train, None), (test, known)))
    slack = vectors.magnitude(of_train.select("v", "n").unionByName(of_test.select("v", "n")))
    place = ["n", "slice"]
    at = [*place, "block"]
    (trained, _), (tested, _) = vectors.numbered(of_train, place), vectors.numbered(of_test, place)
    box = [f(p).alias(f"{p}_{e}") for p in vectors.AXES for f, e in ((F.min, "lo"), (F.max, "hi"))]
    ours = tested.groupBy(*at).agg(F.max(F.col("reach") * F.sqrt("n") * (1 + 1e-9) + slack).alias("reach"), *box).withColumnsRenamed({c: f"{c}_l" for c in at})
    n = F.col("n_l").alias("n")
    ends = ours.withColumn("n", n).withColumn("from", below(F.col("p0_lo") - F.col("reach"))).withColumn("to", below(F.col("p0_hi") + F.col("reach")))
    looks = ends.withColumn("slice_r", F.explode(F.sequence("from", "to"))).withColumnRenamed("n", "n_r")
    theirs = trained.groupBy(*at).agg(*box).select(*(F.col(c).alias(f"{c}_r") for c in at), *(F.col(f"{p}_{e}").alias(f"{p}_{e}_r") for p in vectors.AXES for e in ("lo", "hi")))
    gap = lambda p: F.greatest(F.col(f"{p}_lo") - F.col(f"{p}_hi_r"), F.col(f"{p}_lo_r") - F.col(f"{p}_hi"), F.lit(0.0))
    apart = F.sqrt(reduce(lambda x, y: x + y, (gap(p) * gap(p) for p in vectors.AXES)))
    met = looks.join(theirs, ["n_r", "slice_r"]).where(apart <= F.col("reach") + slack).withColumn("same", F.lit(False))

    def compare(k, x, _, y):
        import pyarrow as pa

        if y is not None:
            i, d = vectors.closest(x, y)
            yield k.take(pa.array(i)), pa.array(d)

    kind = test.schema["id"].dataType.simpleString()
    found = vectors.met(tested, trained, met, place, compare, f"id {kind}, d double").groupBy("id").agg(F.min("d").alias("distance"))
    return test.select("id").join(found, "id", "left")


def leak_stats(distances: DataFrame, marks: tuple[float, ...] = (1, 3, 6), digits: int = 1) -> DataFrame:
    """Median nearest distance and the percentages within each mark."""
    names = [str(m).replace(".", "_") for m in marks]
    within = [F.bround(F.avg((F.col("distance") <= m).cast("double")) * 100, 1).alias(f"pct_within_{n}") for m, n in zip(marks, names, strict=True)]
    return distances.agg(F.bround(F.percentile("distance", F.lit(0.5)), digits).alias("median_nearest"), *within)


def assign_splits(sizes: DataFrame, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """(cluster, size, split): clusters from the largest on, each to the split of largest relative deficit (val, then test, then train on ties).

    The greedy order is sequential: the clusters, a small row each, stream sorted
    through one task that holds the three totals.
    """
    rows = sizes.select("cluster", "size")
    total = float(rows.agg(F.sum("size")).first()[0] or 0)
    wants = (total * val, total * test, total * (1 - val - test))

    def assign(batches):
        import pyarrow as pa

        have = [0.0, 0.0, 0.0]
        for batch in batches:
            out = []
            for size in batch.column(1).to_pylist():
                dv, dt, dr = ((w - h) / max(w, 1.0) for w, h in zip(wants, have, strict=True))
                to = 0 if dv >= dt and dv >= dr else 1 if dt >= dr else 2
                have[to] += size
                out.append(("val", "test", "train")[to])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["cluster", "size", "split"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(1).sortWithinPartitions(F.desc("size"), "cluster").mapInArrow(assign, f"{kinds}, split string")


def copies_histogram(unit_rows: DataFrame) -> DataFrame:
    return unit_rows.groupBy("copies").agg(F.count(F.lit(1)).alias("units"))

