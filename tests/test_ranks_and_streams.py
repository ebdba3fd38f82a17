import math
import random
from collections import defaultdict

import pytest

from boxwright.operators import dedup, sampling, temporal


@pytest.mark.parametrize("gap", [0.0, 0.15, 0.3, 7.0])
def test_min_gap_by_brute_force(spark, gap):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([rng.randrange(90) * 0.1, rng.random() * 9, None])) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = temporal.min_gap(spark.createDataFrame(rows, "s string, k int, t double"), ["s"], "t", "k", gap).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = [], {}
    for s, k, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        if s not in last or t - last[s] >= gap:
            last[s] = t
            want.append((s, k, t))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_top_share_by_brute_force(spark):
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0]
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([rng.random(), rng.choice(odd)])) for i in range(300)] + [("c", i, 1.0) for i in range(40)]
    got = sampling.top_share(spark.createDataFrame(rows, "g string, i int, s double"), "g", "s", "i").collect()
    groups = defaultdict(list)
    for g, i, s in rows:
        groups[g].append((2 if s is None else 0 if math.isnan(s) else 1, 0 if s is None or math.isnan(s) else -s, i))
    want = {(g, r[2]) for g, v in groups.items() for r in sorted(v)[: max(10, int(len(v) * 0.75))]}
    assert {(r.g, r.i) for r in got} == want and len(got) == len(want)


def test_shuffled_ranks_count_every_group(spark):
    rows = [(None if i % 3 == 0 else i % 3, f"p{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "g int, p string")
    ranks = sampling.shuffled(df, ["g"], 7, "p").collect()
    assert len(ranks) == 100
    for g in (None, 1, 2):
        own = [r for r in ranks if r.g == g]
        assert sorted(r["__r"] for r in own) == list(range(1, len(own) + 1)) and {r["__n"] for r in own} == {len(own)}
    assert sampling.fraction(df, ["g"], "p", 0.5).count() == 17 + 16 + 16


def test_assign_splits_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"c{i}", rng.randrange(1, 30)) for i in range(200)]
    have, total, want = [0.0] * 3, sum(n for _, n in rows), {}
    for c, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        short = [(w - h) / max(w, 1.0) for w, h in zip((total * 0.1, total * 0.1, total * (1 - 0.1 - 0.1)), have, strict=True)]
        to = short.index(max(short))
        have[to] += n
        want[c] = ("val", "test", "train")[to]
    df = spark.createDataFrame(rows, "cluster string, size int")
    assert {r.cluster: r.split for r in dedup.assign_splits(df).collect()} == want
    assert dedup.assign_splits(df.where("size < 0")).count() == 0
