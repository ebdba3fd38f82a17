"""Exact Jaccard join of word-shingle sets by universe partition.

Two sets of sizes r and s link at a Jaccard similarity of 3/4 or more only if they
differ in at most H = (r + s) / 7 shingles.  For each size band (a *level*: the band
of the larger set) the hash universe is cut into segments.  By the pigeonhole
principle, of any k segments two linked sets agree on k - H, and differ by at most one
shingle in k - H / 2.  So a set is indexed under

* plan ``exact``: the contents of its first H + 1 + e segments that aren't empty (of
  all segments, empty ones too, where there are fewer), or
* plan ``deletion``: the contents of all of (H + 1) / 2 + e wider segments, and their
  one-deletion neighbourhoods.

Either way linked sets share ``need`` = 1 + e keys, where e is ``EXTRA`` of what one
shared key would take.  Skipping empty segments loses nothing: let x be the one of two
sets whose prefix ends first; whatever of it agrees lies in the other's prefix too.

A level's plan is the one of lower cost, index entries and candidates to verify, both
counted on a bounded sample of the sets: entries grow with the number of sets, chance
candidates with its square.

Equal sets are one class.  Keys travel as sorted blocks (bucket, keys, classes), not
as rows.  Classes of a key that has ``SMALL`` at most are paired directly, with a count
of the keys that each pair shares.  Other keys are *hot*; a pair that shares a key that
isn't hot needs none of them, and a pair that doesn't shares ``need`` hot keys.  So only
classes with as many hot keys at a level matter to them (passages that many texts share
give few), and of those keys all but the need - 1 in the largest groups suffice (a
prefix in one global order).

Groups of hot keys are first joined by trees: in its two largest groups each class is
paired with the closest one of another tree.  After that only members in different
components matter: of a key with ``MEDIUM`` classes at most they are paired; of a larger
one members outside the component that most are in are compared with that component
and among themselves, in blocks.  Closeness is told by parity sketches, whose Hamming
distance never exceeds the sets' difference, so that filter loses nothing.  What passes
is verified in rounds, the closest first; pairs inside a component need no verifying.
Every candidate is verified on the whole sets.  So no link between components is lost,
though links inside one need not be listed.

Shingles are 64-bit fingerprints, and so are classes (with the set's size).

Defined results: a null or wordless text has an empty set and is its own component;
equal sets are linked; rows without an id are grouped like others, and the component
is named by the smallest id in it (null if there is none); repeated rows give one
result row each; an empty table gives no rows.  Other columns are ignored.  A worker
holds some 60 bytes a word of the longest text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .common import arrow_rows, drop_written, written
from .components import components

WIDTH = 5
#: Classes of a key that are paired directly, and how many keys more are indexed than one shared key would take.
SMALL = 8
EXTRA = 0.2
#: Members of a hot key that are paired where they lie in different components.
MEDIUM = 64
#: Keys of a bucket, of a slice of it that is grouped at once, and those that a task gathers before it gives them out.
BUCKET_KEYS = 4 << 20
SLICE_KEYS = 512 << 10
FLUSH_KEYS = 1 << 20
#: Rows of a comparison block; least and most sketch bits.
BLOCK = 4096
SKETCH = (512, 1 << 16)
#: Rows of an Arrow batch, each of which may hold two whole sets.
BATCH = 500
#: Candidates of a class in the first round of comparisons across components, and how many times more the next rounds take: the first
#: joins dense groups, so few pairs are left for the others, and each costs a scan.
NEXT, MORE = 32, 64
#: Parts of the partners of one class when sets are brought together.
SALTS = 32
#: Most bits of the filter that spares texts a shuffle; it has 16 a wanted text up to that, and none is used beyond 2 a text.
FILTER = 1 << 27
#: Shingles in the sample that plans are chosen by, and the cost of a candidate in index entries.
SAMPLED, VERIFY = 250_000, 50.0


def band_edges() -> list[int]:
    """Lower ends of the size bands, each 16/9 of the one before: partners are at most one band apart, and half of all sets need one level only."""
    edges = [1, 2]
    while edges[-1] < 1 << 31:
        edges.append(-(-edges[-1] * 16 // 9))
    return edges


EDGES = np.array(band_edges())


def differs(r: int, s: int) -> int:
    """The most shingles in which linked sets of these sizes differ."""
    return (r + s) // 7


def layout(level: int, deletion: bool) -> tuple[int, int]:
    """(segments, need) of a level: linked sets share so many keys."""
    top = int(EDGES[level + 1]) - 1
    h = differs(top, top)
    least = (h + 2) // 2 if deletion else h + 1
    extra = int(EXTRA * least)
    return (least + extra if deletion else math.ceil(1.25 * (least + extra)) + 2), 1 + extra


def fingerprint(s: np.ndarray) -> int:
    """Names a set: the sum of its mixed shingles and its size."""
    return int(textscan.mix(np.array([textscan.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


#: The last bit of the 48 that are kept of a key says whether its level is odd; a set has keys of two levels at most, one after the other.
_PARITY = np.uint64(1 << 16)


def keys_of(s: np.ndarray, deletion: dict[int, bool]) -> Iterator[tuple[int, np.ndarray]]:
    """(level, index keys) of a set: at the level of its band and, if it can be the smaller set there, at the next."""
    n = len(s)
    band = int(np.searchsorted(EDGES, n, "right")) - 1
    most = n * 4 // 3
    for level in (band, band + 1):
        lo, hi = int(EDGES[level]), int(EDGES[level + 1]) - 1
        if level > band and most < lo:
            continue
        h = differs(n, min(hi, most))
        if h == 0:
            continue  # only equal sets link
        wide = deletion.get(level, False)
        m, need = layout(level, wide)
        cut = np.searchsorted(s, np.array([(1 << 64) * i // m for i in range(1, m)], dtype=np.uint64))
        cut = np.concatenate([[0], cut, [n]])
        size = np.diff(cut)
        mixed = textscan.mix(s ^ np.uint64(0x5851F42D4C957F2D))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        content = sums[cut[1:]] - sums[cut[:-1]]
        salt = textscan.mix(np.arange(m, dtype=np.uint64) + np.uint64((level << 32) + 1))
        if wide:
            seg = np.repeat(np.arange(m), size)
            keys = np.concatenate([content + salt, content[seg] - mixed + salt[seg]])
        else:
            full = np.flatnonzero(size)
            use = full[: h + need] if len(full) >= h + need else np.arange(m)
            keys = content[use] + salt[use]
        keys = textscan.mix(keys)
        yield level, keys | _PARITY if level % 2 else keys & ~_PARITY


def _doc_sets(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    keep = textscan.space_separated()
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in textscan.slices(batch, text_at):
                yield part, list(textscan.shingle_sets(textscan.scan(part.column(text_at), keep), WIDTH))


def plans(rows: DataFrame, total: int) -> dict[int, bool]:
    """For each level whether it uses one-deletion neighbourhoods, by the entries and the pairs sharing enough keys that a sample of some SAMPLED of all total shingles has under both."""
    one_in = max(1, total // SAMPLED)

    def scan(batches):
        for _, sets in _doc_sets(batches, 0):
            for s in sets:
                for wide in (False, True) if len(s) else ():
                    every = dict.fromkeys(range(len(EDGES)), wide)
                    for level, keys in keys_of(s, every):
                        n = len(keys)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, level, np.int32)), pa.array(np.full(n, wide)), pa.array(keys.view(np.int64)), pa.array(np.full(n, fingerprint(s)))], names=["level", "wide", "key", "cls"]
                        )

    keys = rows.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text").mapInArrow(scan, "level int, wide boolean, key bigint, cls bigint").distinct()
    met = keys.groupBy("level", "wide", "key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("cls")).alias("classes"))  # of a bounded sample
    met = met.groupBy("level", "wide").agg(F.sum("n").alias("entries"), F.collect_list(F.when(F.col("n").between(2, SMALL), F.col("classes"))).alias("groups")).collect()
    cost: dict[tuple[int, bool], float] = {}
    for r in met:
        pairs = Counter(p for g in r.groups for p in combinations(g, 2))
        need = layout(r.level, r.wide)[1]
        cost[r.level, r.wide] = r.entries * one_in + VERIFY * sum(n >= need for n in pairs.values()) * one_in**2
    return {level: cost[level, True] < cost[level, False] for level, wide in cost if wide}


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's shingles over hash bins, two bins or more a shingle: sketches differ in no more bits than sets in shingles."""
    bits = min(max(SKETCH[0], 1 << (2 * len(s) - 1).bit_length()), SKETCH[1])
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def fold(marks: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) over fewer bins: bins that fall together add their parities."""
    while marks.shape[-1] > width:
        half = marks.shape[-1] // 2
        marks = marks[..., :half] ^ marks[..., half:]
    return marks


def may_link(n: int, mark: np.ndarray, m: int, other: np.ndarray) -> bool:
    """False only if sets of these sizes and sketches can't link."""
    if 4 * min(n, m) < 3 * max(n, m):
        return False
    width = min(len(mark), len(other))
    return int(np.bitwise_count(fold(mark, width) ^ fold(other, width)).sum()) <= differs(n, m)


def doc_classes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, cls, sketch) of rows (row, doc_id, text); cls and sketch are null for an empty set."""

    def scan(batches):
        for part, sets in _doc_sets(batches, 2):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                names=["row", "doc_id", "n_shingles", "cls", "sketch"],
            )

    return docs.mapInArrow(scan, "row bigint, doc_id bigint, n_shingles bigint, cls bigint, sketch binary")


def sift(pairs: DataFrame, classes: DataFrame, deletion: dict[int, bool]) -> DataFrame:
    """The pairs (a, b) that sizes, sketches and the number c of shared keys that aren't hot don't rule out (a null c: not counted)."""
    side = lambda c: classes.select(F.col("cls").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "sketch", "hot")))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "c", "n_a", "sketch_a", "hot_a", "n_b", "sketch_b", "hot_b")

    def check(batches):
        for batch in batches:
            a, b, c, n, _, hot, m, _, hot_m = (x.to_pylist() if i not in (4, 7) else None for i, x in enumerate(batch.columns))
            marks = lambda i, k, batch=batch: np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64)
            level = np.searchsorted(EDGES, np.maximum(n, m), "right") - 1
            of = {k: layout(k, deletion.get(k, False))[1] for k in np.unique(level).tolist()}
            enough = [c[i] is None or c[i] + min(hot[i][k % 2], hot_m[i][k % 2]) >= of[k] for i, k in enumerate(level.tolist())]
            near = pa.array([enough[i] and may_link(n[i], marks(i, 4), m[i], marks(i, 7)) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return both.mapInArrow(check, "a bigint, b bigint")


def _blocks(keys: np.ndarray, owner: np.ndarray, fps: np.ndarray, sizes: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Sorted blocks, one for each range of keys; the first 48 bits of a key lie there byte plane by byte plane, which packs well."""
    bucket = _bucket_of(keys, buckets)
    keys = keys >> np.uint64(16)
    ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
    a = 0
    for b in ends.tolist():
        who, place = np.unique(owner[a:b], return_inverse=True)
        planes = np.ascontiguousarray(keys[a:b].view(np.uint8).reshape(-1, 8)[:, 5::-1].T)
        yield int(bucket[a]), planes.tobytes(), place.astype("<u2" if len(who) <= 1 << 16 else "<u4").tobytes(), fps[who].tobytes(), sizes[who].tobytes()
        a = b


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


_BLOCK = "bucket int, keys binary, place binary, fps binary, sizes binary"


def index_blocks(docs: DataFrame, deletion: dict[int, bool], buckets: int) -> DataFrame:
    """The keys of all classes in blocks.

    Of a key that more classes of one flush have than SMALL, SMALL + 1 go to the
    bucket, which so knows the key as hot; the others are given out at once, in rows
    with a bucket below 0: keys, members of each, classes.
    """

    def flush(held):
        fps, owners = np.array(list(held), "<i8"), np.repeat(np.arange(len(held)), [len(k) for _, k in held.values()])
        sizes, keys = np.array([n for n, _ in held.values()], "<i4"), np.concatenate([k for _, k in held.values()])
        order = np.argsort(keys >> np.uint64(16), kind="stable")
        keys, owners = keys[order], owners[order]
        start, count = _runs(keys >> np.uint64(16))
        late = np.arange(len(keys)) - np.repeat(start, count) > SMALL
        if late.any():
            yield from _hot_rows(keys[late], owners[late], fps, sizes)
            keys, owners = keys[~late], owners[~late]
        rows = list(_blocks(keys, owners, fps, sizes, buckets))
        for at in range(0, len(rows), 64):
            cols = list(zip(*rows[at : at + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "keys", "place", "fps", "sizes"])

    def _hot_rows(keys, owners, fps, sizes):
        short = keys >> np.uint64(16)
        start, count = _runs(short)
        need = _needs(short[start], sizes[owners[start]], deletion)
        at = int(textscan.mix(short[:1])[0] % np.uint64(1 << 16))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1 - at], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (short[start], count.astype("<i4"), fps[owners], need))], names=["bucket", "keys", "place", "fps", "sizes"]
        )

    def scan(batches):
        held: dict[int, tuple[int, np.ndarray]] = {}
        total = 0
        for _, sets in _doc_sets(batches, 0):
            for s in sets:
                fp = fingerprint(s) if len(s) else None
                if fp is None or fp in held:
                    continue
                keys = [k for _, k in keys_of(s, deletion)]
                if keys:
                    held[fp] = len(s), np.concatenate(keys)
                    total += len(held[fp][1])
                if total > FLUSH_KEYS:
                    yield from flush(held)
                    held, total = {}, 0
        if held:
            yield from flush(held)

    return docs.select("text").mapInArrow(scan, _BLOCK)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal sorted values."""
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(values)))


def _levels(short: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The level of each key, which one of its sets' size and the key's parity tell."""
    band = np.searchsorted(EDGES, sizes, "right") - 1
    return band + ((band ^ (short & np.uint64(1)).astype(np.int64)) & 1)


def _needs(short: np.ndarray, sizes: np.ndarray, deletion: dict[int, bool]) -> np.ndarray:
    """The keys that linked sets share at the level of each key."""
    level = _levels(short, sizes)
    of = {k: layout(k, deletion.get(k, False))[1] for k in np.unique(level).tolist()}
    return np.array([of[k] for k in level.tolist()], "<i4")


def _near(sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = sizes[a], sizes[b]
    return 4 * np.minimum(x, y) >= 3 * np.maximum(x, y)


def _groups(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(classes, sizes, groups) of a bucket; groups come slice by slice of the key range, as sorted distinct (key, class number) of keys with two classes or more."""
    keys, owner, fps, sizes, base = [], [], [], [], 0
    for planes, place, fp, size in rows:
        n = len(planes) // 6
        raw = np.zeros((n, 8), np.uint8)
        raw[:, 5::-1] = np.frombuffer(planes, np.uint8).reshape(6, n).T
        keys.append(raw.view("<u8").reshape(-1))
        f = np.frombuffer(fp, "<i8")
        owner.append(np.frombuffer(place, "<u2" if len(f) <= 1 << 16 else "<u4").astype(np.int32) + np.int32(base))
        fps.append(f)
        sizes.append(np.frombuffer(size, "<i4"))
        base += len(f)
    who, first, name = np.unique(np.concatenate(fps), return_index=True, return_inverse=True)
    size = np.concatenate(sizes)[first].astype(np.int64)
    low, high = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys) + 1
    parts = -(-sum(map(len, keys)) // SLICE_KEYS)
    bounds = np.array([low + (high - low) * i // parts for i in range(parts + 1)], dtype=np.uint64)

    def each():
        cuts = [np.searchsorted(k, bounds) for k in keys]
        for i in range(parts):
            key = np.concatenate([k[c[i] : c[i + 1]] for k, c in zip(keys, cuts, strict=True)])
            cls = name[np.concatenate([o[c[i] : c[i + 1]] for o, c in zip(owner, cuts, strict=True)])]
            order = np.argsort(key)
            key, cls = key[order], cls[order]
            same = key[1:] == key[:-1]
            shared = np.append(same, False) | np.append(False, same) if len(key) else np.zeros(0, bool)
            key, cls = key[shared], cls[shared]
            order = np.lexsort((cls, key))
            key, cls = key[order], cls[order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])) if len(key) else np.zeros(0, bool)
            yield key[fresh], cls[fresh]

    return who, size, each()


def candidates(blocks: DataFrame, parts: int, deletion: dict[int, bool]) -> DataFrame:
    """(hot, a, need, others, shared): pairs as a class, its partners and the keys shared with each; members of a hot key as the key, what linked sets share at its level, and classes."""

    def meet(batches):
        bucket, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] < 0:
                    keys, counts, members, need = (np.frombuffer(x, t) for x, t in zip(row[1:], ("<i8", "<i4", "<i8", "<i4"), strict=True))
                    yield from listed(True, keys, need, counts, members, None)
                    continue
                if row[0] != bucket and held:
                    yield from settle(held)
                    held = []
                bucket = row[0]
                held.append(row[1:])
        if held:
            yield from settle(held)

    def listed(hot, a, need, counts, others, shared):
        ends = np.cumsum(counts)
        at = 0
        while at < len(a):  # batches of bounded length
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, "right")))
            lo, hi = int(ends[at - 1]) if at else 0, int(ends[to - 1])
            offsets = pa.array(np.append(0, ends[at:to] - lo).astype(np.int32))
            partners = pa.ListArray.from_arrays(offsets, pa.array(others[lo:hi]))
            times = pa.nulls(to - at, pa.list_(pa.int32())) if shared is None else pa.ListArray.from_arrays(offsets, pa.array(shared[lo:hi], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([hot] * (to - at)), pa.array(a[at:to]), pa.array(need[at:to], pa.int32()), partners, times], names=["hot", "a", "need", "others", "shared"])
            at = to

    def settle(held):
        who, size, groups = _groups(held)
        band = np.searchsorted(EDGES, size, "right") - 1
        codes = []
        for key, cls in groups:
            start, count = _runs(key)
            for g in range(2, SMALL + 1):
                rows = start[count == g]
                if len(rows):
                    members = cls[rows[:, None] + np.arange(g)]
                    level = _levels(key[rows], size[members[:, 0]])
                    i, j = np.triu_indices(g, 1)
                    a, b = members[:, i].reshape(-1), members[:, j].reshape(-1)
                    ok = _near(size, a, b) & (np.maximum(band[a], band[b]) == np.repeat(level, len(i)))
                    codes.append(a[ok].astype(np.int64) * len(who) + b[ok])
            big = np.flatnonzero(count > SMALL)
            if len(big):
                inside = np.repeat(count > SMALL, count)
                yield from listed(True, key[start[big]].view(np.int64), _needs(key[start[big]], size[cls[start[big]]], deletion), count[big], who[cls[inside]], None)
        code, shared = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)]), return_counts=True)
        if len(code):
            a, b = who[code // len(who)], who[code % len(who)]
            start, count = _runs(a)
            yield from listed(False, a[start], np.zeros(len(start), np.int32), count, b, shared)

    return blocks.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "hot boolean, a bigint, need int, others array<bigint>, shared array<int>")


def dominated(hot: DataFrame) -> DataFrame:
    """(key, cls): the memberships of hot keys (key, need, cls) that pairs without another shared key can't all lack."""
    inc = hot.withColumn("odd", F.col("key") % 2)
    enough = inc.groupBy("cls", "odd").agg(F.count(F.lit(1)).alias("h"), F.max("need").alias("least")).where("h >= least").select("cls", "odd")
    inc = inc.join(enough, ["cls", "odd"])
    groups = inc.groupBy("key").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    mine = Window.partitionBy("cls", "odd")  # as many rows as a set has keys of a level
    ranked = inc.join(groups, "key").withColumns({"r": F.row_number().over(mine.orderBy("g", "key")), "h": F.count(F.lit(1)).over(mine)})
    return ranked.where("h >= need and r <= h - need + 1").select("key", "cls")


def largest(inc: DataFrame, most: int = 2) -> DataFrame:
    """(cell, side, x, root): the memberships (key, cls) of each class in its largest groups, as cells in which every class is its own component."""
    groups = inc.groupBy("key").agg(F.count(F.lit(1)).alias("g"))
    mine = Window.partitionBy("cls").orderBy(F.desc("g"), "key")  # as many rows as a set has keys
    rows = inc.join(groups, "key").withColumn("r", F.row_number().over(mine)).where(F.col("r") <= most)
    return rows.select(F.concat(F.lit("k"), "key").alias("cell"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), F.col("cls").alias("x"), F.col("cls").alias("root"))


def rooted(inc: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, x, root, g), written: the memberships of keys whose members lie in several components, with those components and the number of members."""
    roots = labels.select(F.col("node").alias("cls"), "root")
    rows = inc.join(roots, "cls", "left").select("key", F.col("cls").alias("x"), F.coalesce("root", "cls").alias("root"))
    split = rows.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key", "g")
    return written(rows.join(split, "key"), "rooted")


def medium_pairs(rows: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, b) of members in different components, of keys with MEDIUM members at most."""
    lists = rows.where(F.col("g") <= MEDIUM).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("x", "root"))).alias("members"))  # MEDIUM
    lists = lists.select(F.col("members.x").alias("x"), F.col("members.root").alias("root"))
    near = lists.repartition(parts, F.col("x")[0]).sortWithinPartitions("x")  # like groups lie together, so their pairs are met once

    def unique(held):
        pairs = np.concatenate(held)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))]

    def pair(batches):
        held, size = [], 0
        for batch in batches:
            for x, root in zip(batch.column(0), batch.column(1), strict=True):
                x, root = x.values.to_numpy(), root.values.to_numpy()
                i, j = np.triu_indices(len(x), 1)
                ok = root[i] != root[j]
                held.append(np.stack([x[i[ok]], x[j[ok]]], axis=1))
                size += len(held[-1])
                if size > 1_000_000:
                    held = [unique(held)]
                    size = 0
                    if len(held[0]) > 500_000:
                        yield out(held.pop())
        if held and sum(map(len, held)):
            yield out(unique(held))

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return near.mapInArrow(pair, "a bigint, b bigint").distinct()


def class_sets(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(cls, s): the whole sets of wanted classes, the table named (want, row), from the texts of rows (row, text)."""
    rows = _likely(docs, named, named.count()).join(named, "row").select("want", "text")

    def scan(batches):
        for part, sets in _doc_sets(batches, 1):
            want = part.column(0).to_pylist()
            keep = [(w, s.tobytes()) for w, s in zip(want, sets, strict=True) if len(s) and fingerprint(s) == w]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.binary())], names=["cls", "s"])

    return rows.mapInArrow(scan, "cls bigint, s binary").dropDuplicates(["cls"])  # repeated rows give a set more than once


def _likely(docs: DataFrame, named: DataFrame, wanted: int) -> DataFrame:
    """docs without most of the rows that aren't wanted: a bitmap of hashed rows, FILTER bits at most, spares their shuffle."""
    bits = min(FILTER, max(1 << 20, 1 << (16 * wanted).bit_length()))
    if bits < 2 * wanted:
        return docs
    slot = F.pmod(F.xxhash64("row"), F.lit(bits))
    maps = named.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 32768).alias("__m")).agg(F.bitmap_construct_agg((F.col("slot") % 32768).cast("bigint")).alias("__bits"))
    at = F.col("__s") % 32768
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = docs.withColumn("__s", slot).withColumn("__m", F.floor(F.col("__s") / 32768)).join(F.broadcast(maps), "__m")  # FILTER bits
    return rows.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*docs.columns)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among pairs (a, b), on the whole sets; the set of an a with many partners goes to SALTS tasks."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    firsts = pairs.select("a", "salt").distinct().join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a")
    both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b").join(firsts, ["a", "salt"]).select("a", "b", "sa", "sb")

    def check(batches):
        for batch in batches:
            a, b, sa, sb = batch.columns
            linked = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64)
                small, big = (x, y) if len(x) <= len(y) else (y, x)
                common = int((big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small).sum())
                linked.append(100 * common >= 75 * (len(x) + len(y) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return both.mapInArrow(check, "a bigint, b bigint")


def compared(rows: DataFrame) -> DataFrame:
    """(cell, side, x, root), written: what must be compared across components, of keys with more than MEDIUM members.

    Of each key the component of most members is its main one.  A member outside it
    meets all of that component (a cell a component, whatever keys brought it there),
    and the other members outside it (a cell for all keys with the same smallest
    member, since groups that overlap mostly share it).
    """
    rows = rows.where(F.col("g") > MEDIUM)
    counts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("first"))
    main = counts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.min("first").alias("first"))
    out = written(rows.join(main, "key").where("root <> main").select("first", "main", "x", "root").distinct(), "outside")
    to_main = out.select(F.concat(F.lit("c"), "main").alias("cell"), "x", "root", "main").distinct()
    all_of = rows.select("x", "root").distinct().join(to_main.select(F.col("main").alias("root"), "cell").distinct(), "root")
    among = out.select(F.concat(F.lit("k"), "first").alias("cell"), "x", "root").distinct()
    side = lambda df, n: df.select("cell", F.lit(n).alias("side"), "x", "root")
    cells = written(side(to_main, 0).unionByName(side(all_of, 1)).unionByName(side(among, 0)).unionByName(side(among, 1)), "cells")
    drop_written(out)
    return cells


def still_open(cells: DataFrame, open_: DataFrame, labels: DataFrame) -> DataFrame:
    """The cells of classes open_ (x), with the components that all members are in by now."""
    firsts = cells.where("side = 0").join(open_, "x", "left_semi")
    others = cells.where("side = 1").join(firsts.select("cell").distinct(), "cell", "left_semi")
    return firsts.unionByName(others).join(labels.select(F.col("node").alias("x"), F.col("root").alias("now")), "x", "left").withColumn("now", F.coalesce("now", "x"))


def across(rows: DataFrame, classes: DataFrame, parts: int, lo: int, hi: int, trees: bool = False) -> DataFrame:
    """Pairs (a, b) of the two sides of each cell, in different components, that sketches don't rule out.

    Each class's candidates in a block are ranked by how close their sketches are,
    among all that were in another component (root) when the cells were made, so ranks
    stay what they are; those of ranks lo to hi come out if they are in another one
    (now) still, and a row without b says that there are more.  With trees, each class
    is only paired with the closest one that the block's pairs so far don't join it with.
    """
    if "now" not in rows.columns:
        rows = rows.withColumn("now", F.col("root"))
    sized = rows.groupBy("cell").agg(F.ceil(F.count_if(F.col("side") == 0) / BLOCK).cast("int").alias("n0"), F.ceil(F.count_if(F.col("side") == 1) / BLOCK).cast("int").alias("n1"))
    rows = rows.join(sized, "cell").join(classes.select(F.col("cls").alias("x"), "n", "sketch"), "x")
    place = F.xxhash64("x", "cell")
    mine, other = F.pmod(place, F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0"))
    few, common = F.col("n0") + F.col("n1") == 2, ["cell", "side", "x", "n", "sketch", "root", "now"]
    grid = rows.where(~few).withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), other - 1))})
    grid = grid.select(*common, *(F.when((F.col("side") == 0) == first, F.col("mine")).otherwise(F.col("other")).cast("int").alias(c) for c, first in (("i", F.lit(True)), ("j", F.lit(False)))))
    cells = rows.where(few).select(*common, F.lit(0).alias("i"), F.lit(0).alias("j")).unionByName(grid)
    cells = cells.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")

    def cross(fs: list[tuple], us: list[tuple]) -> pa.RecordBatch:
        by_width: dict[int, list[tuple]] = {}
        for u in us:
            by_width.setdefault(len(u[2]) // 8, []).append(u)
        packed = {}
        for width, some in by_width.items():
            marks = np.frombuffer(b"".join(u[2] for u in some), np.uint64).reshape(len(some), width)
            packed[width] = (np.array([u[0] for u in some]), np.array([u[1] for u in some], np.int64), marks, np.array([u[3] for u in some]), np.array([u[4] for u in some]))
        out, joined = set(), {}

        def tree(root):
            while root in joined:
                root = joined[root]
            return root

        for x, n, mark, root, now in fs:
            own = np.frombuffer(mark, np.uint64)
            root = tree(root)
            gaps, names, roots = [], [], []
            for width, (ux, un, um, ur, unow) in packed.items():
                look = np.flatnonzero((4 * np.minimum(n, un) >= 3 * np.maximum(n, un)) & (ur != root))
                if len(look):
                    least = min(width, len(own))
                    gap = np.bitwise_count(fold(um[look], least) ^ fold(own, least)).sum(axis=1)
                    use = gap <= (n + un[look]) // 7
                    gaps.append(gap[use].astype(np.int64))
                    names.append(ux[look[use]])
                    roots.append((ur if trees else unow)[look[use]])
            if gaps:
                name, found = np.concatenate(names), np.concatenate(roots)
                order = np.lexsort((name, np.concatenate(gaps)))
                name, other = name[order], found[order] != now
                if trees and len(name):
                    y, old = int(name[0]), found[order[0]]
                    out.add((min(x, y), max(x, y)))
                    joined[int(old)] = root
                    for _, _, _, ur, _ in packed.values():
                        ur[ur == old] = root
                    continue
                out |= {(min(x, y), max(x, y)) for y in name[lo:hi][other[lo:hi]].tolist()}
                if other[hi:].any():
                    out.add((x, None))
        pairs = list(out)
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def scan(batches):
        at, held = None, ([], [])
        for batch in batches:
            for cell, side, x, n, mark, root, now, i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, i, j) != at:
                    if held[0] and held[1]:
                        yield cross(*held)
                    at, held = (cell, i, j), ([], [])
                held[side].append((x, n, mark, root, now))
        if held[0] and held[1]:
            yield cross(*held)

    return cells.mapInArrow(scan, "a bigint, b bigint").distinct()


def join(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id."""
    with arrow_rows(docs.sparkSession, BATCH):
        return _join(docs)


def _linked(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links among pairs; sets are made anew from the texts of their classes alone."""
    members = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    named = written(classes.select("cls", "row").join(members, "cls", "left_semi").select(F.col("cls").alias("want"), "row"), "wanted")
    sets = written(class_sets(rows, named), "sets")
    out = written(verify(pairs, sets), "verified")
    drop_written(named, sets)
    return out


def _join(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    named = written(doc_classes(rows), "classes")
    classes = named.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.max("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"))
    classes = written(classes, "reps")
    total = classes.agg(F.sum("n")).first()[0] or 0
    deletion = plans(rows, total)
    met = written(candidates(index_blocks(rows, deletion, max(parts, total // BUCKET_KEYS + 1)), parts, deletion), "met")
    hot = written(met.where("hot").select(F.col("a").alias("key"), "need", F.explode("others").alias("cls")).distinct(), "hot")
    has = lambda odd: F.count_if(F.col("key") % 2 == odd).cast("int")
    counts = hot.groupBy("cls").agg(F.array(has(0), has(1)).alias("hot"))
    known = classes.join(counts, "cls", "left").withColumn("hot", F.coalesce("hot", F.array(F.lit(0), F.lit(0))))
    pairs = met.where("not hot").select("a", F.explode(F.arrays_zip("others", "shared")).alias("p")).groupBy("a", F.col("p.others").alias("b")).agg(F.sum("p.shared").alias("c"))
    inc = written(dominated(hot), "dominated")
    near = sift(pairs, known, deletion).unionByName(across(largest(inc), classes, parts, 0, 1, trees=True))
    near = written(near.distinct(), "near")
    links = _linked(rows, classes, near)
    labels = components(links)
    drop_written(met, hot, near, links)
    split = rooted(inc, labels)
    cells = compared(split)
    pairs = medium_pairs(split, parts).withColumn("c", F.lit(None).cast("bigint"))
    none = classes.withColumn("hot", F.array(F.lit(0), F.lit(0)))
    lo, hi = 0, NEXT
    found = written(across(cells, classes, parts, lo, hi).unionByName(sift(pairs, none, deletion)).distinct(), "across")
    drop_written(inc, split)
    while True:
        more, open_ = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("x"))
        if not more.isEmpty():
            late = _linked(rows, classes, more)
            old, labels = labels, components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))
            drop_written(old, late)
        if open_.isEmpty():
            break
        lo, hi = hi, hi * MORE
        last, found = found, written(across(still_open(cells, open_, labels), classes, parts, lo, hi), "across")
        drop_written(last)
    drop_written(found, cells)
    of = classes.select("cls", "rep").join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = written(of.join(least, "root").select("cls", "component_id"), "placed")
    drop_written(classes, labels)
    out = named.join(placed, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
