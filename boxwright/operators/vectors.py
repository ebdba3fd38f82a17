"""Vectors compared in blocks: placed by projections, pruned by what those rule out, met by matrix products.

A projection on a unit vector never moves two vectors of one length n further apart
than sqrt(n) x RMSE.  The unit vectors are the main directions of a bounded sample;
they decide how much is pruned, never what is found.  Rows lie in blocks of about
``BLOCK`` rows, tasks see pairs of blocks one after the other, so a worker holds two
blocks.  Vectors that are empty or have null, NaN or infinite entries are near to
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import shared_dir

#: Rows to a block.
BLOCK = 1024
#: Vectors whose main directions are taken, and how many directions.
SAMPLE = 1024
DIRECTIONS = 3
#: Sampled projections to a slice.
SLICE = 8
#: Pairs compared exactly at once.
CHUNK = 1 << 14
AXES = [f"p{i}" for i in range(DIRECTIONS)]


def usable(vec: str) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return (F.size(vec) > 0) & ~F.exists(vec, odd)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sample(rows: DataFrame, key: str, vec: str) -> dict[int, np.ndarray]:
    """Up to SAMPLE vectors, by length."""
    found = rows.where(usable(vec)).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(F.col(vec).cast("array<double>")).collect()
    out: dict[int, list] = {}
    for (v,) in found:
        out.setdefault(len(v), []).append(v)
    return {n: np.array(v) for n, v in out.items()}


def directions(sampled: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The main directions of each length's sample, as rows; fewer where there are fewer."""
    return {n: np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:DIRECTIONS] for n, x in sampled.items()}


def projected(rows: DataFrame, key: str, vec: str, axes: dict[int, np.ndarray], known: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(k, v, n, p0.., reach): usable rows with length and projections (0 where the sample has no such length), and the distance to the nearest known vector, infinite without one."""
    base = rows.where(usable(vec)).select(F.col(key).alias("k"), F.col(vec).alias("v"), F.size(vec).alias("n"))
    kind = base.schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            out, reach = np.zeros((DIRECTIONS, len(sizes))), np.full(len(sizes), np.inf)
            for n in set(sizes.tolist()):
                at = np.flatnonzero(sizes == n)
                x = matrix(batch.column(1).take(pa.array(at)))
                if n in axes:
                    out[: len(axes[n]), at] = axes[n] @ x.T
                if known and n in known:
                    for part in range(0, len(at), BLOCK):
                        i, d = closest(x[part : part + BLOCK], known[n])
                        reach[at[part + i]] = d
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p) for p in out), pa.array(reach)], names=["k", "v", "n", *AXES, "reach"])

    made = "".join(f", {a} double" for a in [*AXES, "reach"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    shared_dir(rows.sparkSession)
    return base.mapInArrow(place, schema + made).checkpoint()


def magnitude(rows: DataFrame) -> float:
    """A bound of what rounding can move a projection by."""
    most = rows.agg(F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double"))) * F.col("n") * F.sqrt("n"))).first()[0]
    return (most or 0.0) * 1e-14


def numbered(rows: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with the number of their block in their place, and the places with the number of blocks."""
    places = rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return rows.join(places, place).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).drop("blocks"), places


def met(left: DataFrame, right: DataFrame, pairs: DataFrame, place: list[str], compare: Callable, schema: str) -> DataFrame:
    """compare(keys, vectors, keys, vectors) -> arrays, for every pair of blocks (pairs has the columns of place and block with the suffixes _l and _r); the right side is None where a block meets itself."""
    at = [*place, "block"]
    named = pairs.withColumn("pair", F.concat_ws("|", *(f"{c}_{s}" for s in "lr" for c in at)))

    def side(rows: DataFrame, s: str, n: int) -> DataFrame:
        wanted = named if n == 0 else named.where("not same")
        keys = wanted.select("pair", *(F.col(f"{c}_{s}").alias(c) for c in at))
        return rows.select(*at, "k", "v").join(keys, at).select("pair", F.lit(n).alias("side"), "k", "v")

    both = side(left, "l", 0).unionByName(side(right, "r", 1)).repartition("pair").sortWithinPartitions("pair", "side")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_pair, held = None, ([], [])

        def done():
            if held[0]:
                keys = [pa.concat_arrays([k for k, _ in h]) if h else None for h in held]
                vecs = [np.concatenate([v for _, v in h]) if h else None for h in held]
                for columns in compare(keys[0], vecs[0], keys[1], vecs[1]):
                    yield pa.RecordBatch.from_arrays(list(columns), names=names)

        for batch in batches:
            start = 0
            marks = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for (pair, n), run_of in groupby(marks):
                size = sum(1 for _ in run_of)
                if pair != open_pair:
                    yield from done()
                    open_pair, held = pair, ([], [])
                held[n].append((batch.column(2).slice(start, size), matrix(batch.column(3).slice(start, size))))
                start += size
        yield from done()

    return both.mapInArrow(run, schema)


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by a matrix product, and a bound of their rounding."""
    mean = x.mean(axis=0)
    x, y = x - mean, y - mean
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    return xx[:, None] + yy[None, :] - 2 * (x @ y.T), 1e-12 * (xx.max() + yy.max()) * max(1, x.shape[1] / 64)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """RMSE row by row, summed from the first entry on."""
    d = x - y
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1] / x.shape[1])


def within(x: np.ndarray, y: np.ndarray, threshold: float, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most threshold apart (of one block with itself: i < j), in chunks."""
    squares, slack = _squares(x, y)
    near = squares <= threshold * threshold * x.shape[1] + slack
    i, j = np.nonzero(np.triu(near, 1) if ordered else near)
    for at in range(0, len(i), CHUNK):
        a, b = i[at : at + CHUNK], j[at : at + CHUNK]
        keep = exact(x[a], y[b]) <= threshold
        yield a[keep], b[keep]


def closest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's number and its distance to the nearest row of y."""
    squares, slack = _squares(x, y)
    i, j = np.nonzero(squares <= squares.min(axis=1)[:, None] + 2 * slack)
    best = np.full(len(x), np.inf)
    for at in range(0, len(i), CHUNK):
        a, b = i[at : at + CHUNK], j[at : at + CHUNK]
        np.minimum.at(best, a, exact(x[a], y[b]))
    return np.arange(len(x)), best
