"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments.  A segment holds the postings of a run of whole
training texts: for each term the sorted positions at which it occurs, with the
texts laid end to end on one position axis, ``GAP`` positions apart, so that no match
spans two texts.  All terms are stored, so one index serves any benchmark.

A window of an item is looked up by its anchor, the term of it that is rarest in the
whole index: only windows whose anchor a segment has are tried there.  A phrase is
found by intersecting the offset-adjusted position lists of its terms, beginning with
the list that is shortest in the segment; a proximity match is a run of at most
``NEAR`` words that holds all words of a window in any order, sought around its
rarest word.

Segments never move: building and searching are two scans without a shuffle, and
items travel to the segments in blocks of bounded size; where blocks are read from
files, a group of segments shares each.  Segments go to a worker one at a time, or an
executor would hold a whole partition's in Arrow buffers beside its heap.  Beyond its
text a segment needs some 25 bytes a word, so a worker must hold that for the longest
text.

Defined results: a null or wordless text has no words, is hit nowhere and is not
contaminated; an item without an id or without words is ignored; repeated ids of
one item count once; repeated document rows give one result row each; empty
tables give empty results or no hits.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import arrow_rows, drop_written, filesystem, scratch_path, written

#: Words of a window, and the free positions between two texts of a segment.
WIDTH = 13
GAP = 64
#: Bytes of text in a segment (one text at least).
SEGMENT_BYTES = 2 << 20
#: Item words that may be held on the driver and sent along with a scan; beyond, blocks of so many are read from the shared folder.
BLOCK_WORDS = 500_000
#: Words among which all words of a window count as a proximity match, and postings of the segments that share the reading of a block.
NEAR = 20
GROUP = 4 << 20
#: Documents in an Arrow batch on their way into the index.
BATCH = 1000

_SEGMENT = "doc_ids array<bigint>, n_words array<int>, base array<bigint>, terms array<bigint>, ptr array<bigint>, positions array<int>"


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item string, words array<bigint>): the term fingerprints of each item, in order."""
    keep = textscan.alphanumeric()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, 1):
                words = textscan.scan(part.column(1), keep)
                flat = pa.array(words.hashes().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(words.ptr.astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["item", "words"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "item string, words array<bigint>").where(F.size("words") > 0)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of all texts as a table of segments."""
    keep = textscan.alphanumeric()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, 1, SEGMENT_BYTES):
                yield _segment(part, keep)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, _SEGMENT)


def _one(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _segment(part: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    words = textscan.scan(part.column(1), keep)
    h = words.hashes()
    counts = np.diff(words.ptr)
    base = words.ptr[:-1] + GAP * np.arange(len(counts), dtype=np.int64)
    at = np.arange(len(h), dtype=np.int64) + np.repeat(GAP * np.arange(len(counts), dtype=np.int64), counts)
    order = np.argsort(h, kind="stable")
    terms, begin = np.unique(h[order], return_index=True)
    ptr = np.append(begin, len(order))
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
            _one(counts.astype(np.int32), pa.int32()),
            _one(base, pa.int64()),
            _one(terms.view(np.int64), pa.int64()),
            _one(ptr.astype(np.int64), pa.int64()),
            _one(at[order].astype(np.int32), pa.int32()),
        ],
        names=["doc_ids", "n_words", "base", "terms", "ptr", "positions"],
    )


class Segment:
    """One segment, ready for search."""

    def __init__(self, row: dict):
        self.n_words, self.base, self.ptr, self.positions = (row[k] for k in ("n_words", "base", "ptr", "positions"))
        self.terms = row["terms"].view(np.uint64)

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term's list, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1, dtype=np.int64)
        found = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[found] == terms, found, -1)

    def postings(self, slot: int) -> np.ndarray:
        return self.positions[self.ptr[slot] : self.ptr[slot + 1]]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, at, "right") - 1

    def phrase(self, slots: np.ndarray) -> np.ndarray:
        """Positions at which the phrase of these lists begins: lists are intersected from the rarest on."""
        sizes = self.ptr[slots + 1] - self.ptr[slots]
        first, *rest = np.argsort(sizes, kind="stable").tolist()
        found = self.postings(slots[first]) - first
        for t in rest:
            have = self.postings(slots[t])
            seek = found + t
            found = found[have[np.minimum(np.searchsorted(have, seek), len(have) - 1)] == seek]
            if not len(found):
                break
        return found

    def near(self, slots: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest term around which all terms stand inside ``within`` consecutive words (any order)."""
        lists = sorted((self.postings(s) for s in np.unique(slots)), key=len)
        found = lists[0].astype(np.int64)
        for x in lists[1:]:  # first the places that have each term somewhere near
            found = found[np.searchsorted(x, found - within + 1) < np.searchsorted(x, found + within)]
        out = []
        for at in found.tolist():
            around = [x[np.searchsorted(x, at - within + 1) : np.searchsorted(x, at + within)] for x in lists[1:]]
            for lo in sorted({at, *(v for x in around for v in x.tolist() if v <= at)}):
                if lo + within > at and all(np.searchsorted(x, lo) < np.searchsorted(x, lo + within) for x in around):
                    out.append(at)
                    break
        return np.array(out, dtype=np.int64)


class Windows:
    """A block of items cut into windows, filed under their anchors."""

    def __init__(self, items: list[str], words: list[np.ndarray], width: int, counts: dict[int, int]):
        self.items = items
        self.terms, flat = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_inverse=True)
        count = np.array([counts.get(t, 0) for t in self.terms.view(np.int64).tolist()], dtype=np.int64)
        self.rows: list[tuple[int, np.ndarray]] = []  # (item, numbers of its terms)
        anchors, at = [], 0
        for i, w in enumerate(words):
            mine = flat[at : at + len(w)]
            at += len(w)
            for row in np.lib.stride_tricks.sliding_window_view(mine, min(len(w), width)):
                self.rows.append((i, row))
                anchors.append(int(row[np.argmin(count[row])]))
        order = np.argsort(np.array(anchors, dtype=np.int64), kind="stable")
        self.filed = order
        self.anchor, first = np.unique(np.array(anchors, dtype=np.int64)[order], return_index=True)
        self.first = np.append(first, len(order))

    def tried(self, slots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, slots of its window) for windows all of whose terms have a slot, found through their anchors."""
        for k in np.flatnonzero(slots[self.anchor] >= 0).tolist() if len(self.anchor) else ():
            for r in self.filed[self.first[k] : self.first[k + 1]].tolist():
                item, row = self.rows[r]
                found = slots[row]
                if (found >= 0).all():
                    yield item, found


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names) if name != "doc_ids"} | {"doc_ids": batch.column(0)[i].values}


class Search:
    """What a segment's texts have of the items."""

    def __init__(self, row: dict, width: int):
        self.segment, self.doc_ids = Segment(row), row["doc_ids"]
        self.n, self.base, self.width = self.segment.n_words.astype(np.int64), self.segment.base, width
        self.hit = np.zeros(int(self.base[-1] + self.n[-1]) + width + 1 if len(self.n) else 0, dtype=np.int32)
        self.items: dict[int, set] = {}
        self.near: dict[int, set] = {}

    def look(self, block: Windows, within: int) -> None:
        for item, slots in block.tried(self.segment.slots(block.terms)):
            starts = self.segment.phrase(slots)
            name = block.items[item]
            if len(starts):
                np.add.at(self.hit, starts, 1)
                np.add.at(self.hit, starts + len(slots), -1)
                for d in np.unique(self.segment.doc_of(starts)).tolist():
                    self.items.setdefault(d, set()).add(name)
            for d in np.unique(self.segment.doc_of(self.segment.near(slots, within))).tolist():
                self.near.setdefault(d, set()).add(name)

    def result(self) -> pa.RecordBatch:
        covered = np.concatenate([[0], np.cumsum(np.cumsum(self.hit) > 0)])
        names = lambda found: pa.array([sorted(found.get(d, ())) for d in range(len(self.n))], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays(
            [self.doc_ids, pa.array(self.n), pa.array(covered[self.base + self.n] - covered[self.base]), names(self.items), names(self.near)], names=["doc_id", "n_words", "n_hit", "items", "near_items"]
        )


def matches(index: DataFrame, blocks, width: int = WIDTH, within: int = NEAR, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near_items): for each indexed text its hit words, the items with an occurring window and those with all words of one within so many words.  Segments of so many postings (group) share one reading of the blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in _rows(batch):
                held.append(Search(row, width))
                size += len(row["positions"])
                if size >= group:
                    yield from settle(held)
                    held, size = [], 0
        yield from settle(held)

    def settle(held: list[Search]) -> Iterator[pa.RecordBatch]:
        for block in blocks() if held else ():
            for one in held:
                one.look(block, within)
        for one in held:
            if len(one.n):
                yield one.result()

    return index.mapInArrow(search, "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, near_items array<string>")


def term_counts(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n): how often each wanted term occurs in the index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(np.diff(batch.column(1)[i].values.to_numpy()))], names=["term", "n"])

    counted = index.select("terms", "ptr").mapInArrow(scan, "term bigint, n bigint")
    return counted.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))


def proximity_matches(index: DataFrame, queries: dict[str, list[str]], within: int) -> DataFrame:
    """(query, doc_id, position): places where all words of a query stand within so many consecutive words, in any order."""
    if within > GAP:
        raise ValueError(f"within may be {GAP} at most")
    names = list(queries)
    keep = textscan.alphanumeric()
    terms = [textscan.scan(pa.array([" ".join(queries[q])]), keep).hashes() for q in names]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                segment, out = Segment(row), []
                for name, t in zip(names, terms, strict=True):
                    slots = segment.slots(t)
                    if len(t) and (slots >= 0).all():
                        at = segment.near(slots, within)
                        d = segment.doc_of(at)
                        out += [(name, row["doc_ids"][k].as_py(), int(p - segment.base[k])) for k, p in zip(d.tolist(), at.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["query", "doc_id", "position"])

    return index.mapInArrow(search, "query string, doc_id bigint, position bigint")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: int = 20) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, n_near, near_items.

    A document is contaminated if it has hit words and they are at least one in
    ``share`` of its words.  Proximity matches are reported and decide nothing.
    """
    if width > NEAR or NEAR > GAP:
        raise ValueError(f"a window may have {NEAR} words at most")
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH):
        index = written(build_index(docs), "postings")
        listed = written(item_words(items), "items")
    with arrow_rows(spark, 1):
        blocks, group = _blocks(index, listed, width)
        found = written(matches(index, blocks, width, group=group), "matches")
    drop_written(index, listed)
    size = lambda c: F.size(c).cast("bigint")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        size("items").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "items",
        size("near_items").alias("n_near"),
        "near_items",
    )


def _blocks(index: DataFrame, listed: DataFrame, width: int):
    """A function that gives the items in blocks, their windows anchored at the terms that are rarest in the index, and the postings that are to share its reading (0: there is one block, in memory)."""
    spark = index.sparkSession
    total, rows = listed.agg(F.sum(F.size("words")), F.count(F.lit(1))).first()
    as_words = lambda x: np.array(x, dtype=np.int64).view(np.uint64)
    if (total or 0) <= BLOCK_WORDS:
        vocabulary = listed.select(F.explode("words").alias("term")).distinct()  # BLOCK_WORDS terms at most
        counts = {r.term: r.n for r in term_counts(index, vocabulary).collect()}
        held = listed.collect()
        one = Windows([r.item for r in held], [as_words(r.words) for r in held], width, counts)
        return lambda: [one], 0
    path = scratch_path(spark, "blocks")
    listed.repartition(max(1, -(-total // BLOCK_WORDS)), "item").write.option("maxRecordsPerFile", max(1, BLOCK_WORDS * rows // total)).parquet(path)
    files = spark.read.parquet(path).inputFiles()

    def blocks():
        import pyarrow.parquet as pq

        for uri in files:
            store, at = filesystem(uri)
            t = pq.read_table(at, filesystem=store)
            words = [as_words(x) for x in t.column("words").to_pylist()]
            terms, n = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_counts=True)
            yield Windows(t.column("item").to_pylist(), words, width, dict(zip(terms.view(np.int64).tolist(), n.tolist(), strict=True)))  # anchored at what is rarest in the block

    return blocks, GROUP
