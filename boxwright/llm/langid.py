"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A
word's probability is the sum over all ways to cut it into pieces, found by the
forward algorithm; a text's score is the sum of its words' log probabilities, and
the posterior over languages follows with equal priors.  The piece probabilities are
fitted by expectation maximisation (forward-backward) on word counts of a bounded
sample: at most ``SAMPLE`` training documents of each language, those with the
smallest hashes of their ids, with their whole texts.

Words are runs of letters of the lower-cased text (a-z and all non-ASCII
characters), taken with the space before them, since pieces have one, and whole
however long they are: the forward pass slides over a run, keeps as many positions
as the longest piece has bytes, and rescales as it goes.  Every piece of the
vocabulary that can occur in such a run is used.

The sample's word counts stay in the shared folder; each round of the fit sums the
expected counts on the executors, and the driver gets one number for a piece and
language.

Defined results: a null text, and one without a letter, is ``und`` with score 0; so is
every text where no training document has a language.  Languages of equal posterior:
the first by name is predicted.  Repeated rows give one result row each; an empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .common import drop_written, written

#: Training documents of a language, and languages.
SAMPLE = 1000
MOST_LANGUAGES = 500
#: Parts in which a language's ids are ranked before the last ranking, which so has at most PARTS * SAMPLE rows.
PARTS = 16
#: Rounds of fitting and what is added to each piece's expected count.
ROUNDS = 3
PRIOR = 0.05
#: Words of up to EXACT bytes are scored together by their length, longer ones by ranges of lengths; positions between rescalings.
EXACT = 32
RESCALE = 16
#: Slots of the piece table.
_SLOTS = 1 << 22
_SEED = np.uint64(0x9FB21C651E98DF25)


class Pieces:
    """The pieces of a vocabulary file that letter runs may hold, found by the hash of their bytes."""

    def __init__(self, path: str):
        keep = textscan.letters()
        words = {bytes([b]) for b in range(256)}
        with open(path, "rb") as file:
            for line in file:
                raw = base64.b64decode(line.split()[0])
                body = raw[1:] if raw[:1] == b" " else raw
                if raw and all(keep[x] for x in body):
                    words.add(raw)
        self.pieces = sorted(words)
        self.size = len(self.pieces)
        self.lengths = sorted({len(p) for p in self.pieces})
        self.longest = self.lengths[-1]
        size = np.array([len(p) for p in self.pieces])
        stop = np.cumsum(size)
        self.slot_key = np.zeros(_SLOTS, dtype=np.uint64)
        self.slot_id = np.full(_SLOTS, -1, dtype=np.int32)
        keys = textscan.mix(textscan.span_hashes(np.frombuffer(b"".join(self.pieces), dtype=np.uint8), stop - size, stop) ^ _SEED)
        for i, (key, place) in enumerate(zip(keys, _place(keys).tolist(), strict=True)):
            while self.slot_id[place] >= 0:  # a taken slot: the next one
                place = (place + 1) % _SLOTS
            self.slot_key[place], self.slot_id[place] = key, i

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        place = _place(keys)
        out = np.where(self.slot_key[place] == keys, self.slot_id[place], -1)
        open_ = np.flatnonzero((out < 0) & (self.slot_id[place] >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) % _SLOTS
            at = place[open_]
            out[open_] = np.where(self.slot_key[at] == keys[open_], self.slot_id[at], -1)
            open_ = open_[(out[open_] < 0) & (self.slot_id[at] >= 0)]
        return out


@cache
def pieces_of(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(path)


def _place(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(42)).astype(np.int64)


def cut_words(texts: pa.Array) -> textscan.Words:
    """The letter runs of each lower-cased text."""
    return textscan.scan(pc.utf8_lower(texts.cast(pa.large_string())), textscan.letters())


def groups(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of like lengths: their numbers, their bytes with the space before them (padded to one width), their lengths with it."""
    size = stop - start
    width = np.where(size <= EXACT, size, np.ceil(EXACT * 1.25 ** np.ceil(np.log(np.maximum(size, EXACT) / EXACT) / np.log(1.25))).astype(np.int64) + 1)
    for n in np.unique(width).tolist():
        every = np.flatnonzero(width == n)
        most = max(1, 400_000 // (n + 1))
        for lo in range(0, len(every), most):
            at = every[lo : lo + most]
            inside = np.arange(n) < size[at][:, None]
            body = data[np.where(inside, start[at][:, None] + np.arange(n), 0)] * inside
            yield at, np.concatenate([np.full((len(at), 1), 0x20, np.uint8), body.astype(np.uint8)], axis=1), size[at] + 1


class Lattice:
    """The pieces that end at each position of a group of words."""

    def __init__(self, pieces: Pieces, rows: np.ndarray):
        self.pieces, self.width = pieces, rows.shape[1]
        self.bytes = textscan._BYTE[rows]

    def ending(self, j: int) -> Iterator[tuple[int, np.ndarray]]:
        """(from, piece ids) of the pieces that end at j; -1 where none fits."""
        longest = min(j, self.pieces.longest)
        part = np.zeros(len(self.bytes), dtype=np.uint64)
        lengths = set(self.pieces.lengths)
        for n in range(1, longest + 1):  # byte by byte to the left: h = first byte + R * rest
            part = part * textscan._R_64 + self.bytes[:, j - n]
            if n in lengths:
                yield j - n, self.pieces.find(textscan.mix(part ^ _SEED))


def forward(lattice: Lattice, probs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[word, language]: log of the summed probability of all segmentations of each word."""
    n, langs, keep = len(sizes), probs.shape[1], lattice.pieces.longest
    alpha, scale, out = {0: np.ones((n, langs))}, np.zeros(n), np.zeros((n, langs))
    for j in range(1, lattice.width + 1):
        here = np.zeros((n, langs))
        for i, ids in lattice.ending(j):
            use = np.flatnonzero(ids >= 0)
            if len(use):
                here[use] += alpha[i][use] * probs[ids[use]]
        alpha[j] = here
        alpha.pop(j - keep, None)
        done = np.flatnonzero(sizes == j)
        if len(done):
            out[done] = np.log(here[done] + 1e-300) + scale[done, None]
        if j % RESCALE == 0:
            by = np.max([a.max(axis=1) for a in alpha.values()], axis=0)
            by[by == 0] = 1
            for a in alpha.values():
                a /= by[:, None]
            scale += np.log(by)
    return out


def expected(lattice: Lattice, probs: np.ndarray | None, sizes: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
    """Adds to total how often each piece occurs in all segmentations of the words; without probs, in all places where it fits.

    Words are at most a whole group wide; each position's alpha and beta are kept,
    scaled to a largest value of one, since only their products count.
    """
    width = lattice.width
    spans = [[(i, np.where(sizes >= j, ids, -1)) for i, ids in lattice.ending(j)] for j in range(1, width + 1)]
    if probs is None:
        for ids in (ids for at in spans for _, ids in at):
            use = ids >= 0
            np.add.at(total, ids[use], counts[use])
        return
    n = len(sizes)
    alpha, la = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    alpha[0] = 1
    for j, at in enumerate(spans, 1):
        base = la[j - 1]
        for i, ids in at:
            use = np.flatnonzero(ids >= 0)
            alpha[j, use] += alpha[i, use] * np.exp(la[i, use] - base[use]) * probs[ids[use]]
        by = np.where(alpha[j] > 0, alpha[j], 1)
        alpha[j] /= by
        la[j] = base + np.log(by)
    word = la[sizes, np.arange(n)]
    beta, lb = np.zeros((width + 1, n)), np.full((width + 1, n), -np.inf)
    beta[sizes, np.arange(n)], lb[sizes, np.arange(n)] = 1, 0
    for j in range(width, 0, -1):
        by = np.where(beta[j] > 0, beta[j], 1)
        beta[j] /= by
        lb[j] = np.where(np.isfinite(lb[j]), lb[j] + np.log(by), lb[j])
        for i, ids in spans[j - 1]:
            use = np.flatnonzero((ids >= 0) & np.isfinite(lb[j]))
            p = probs[ids[use]] * beta[j, use]
            fresh = use[~np.isfinite(lb[i, use])]
            lb[i, fresh] = lb[j, fresh]
            beta[i, use] += p * np.exp(lb[j, use] - lb[i, use])
            np.add.at(total, ids[use], counts[use] * alpha[i, use] * p * np.exp(la[i, use] + lb[j, use] - word[use]))


def training(docs: DataFrame, lang_col: str, usable: Column) -> DataFrame:
    """The bounded sample: doc_id, text, lang."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(usable)
    ids = rows.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct()
    part = Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h", "doc_id")
    first = ids.withColumn("r", F.row_number().over(part)).where(F.col("r") <= SAMPLE)  # of each part, so that no language is ranked in one task
    rank = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = written(first.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= SAMPLE).select("doc_id", "lang"), "sample-ids")
    if ids.count() > MOST_LANGUAGES * SAMPLE:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return rows.join(F.broadcast(ids), ["doc_id", "lang"])


def learn(docs: DataFrame, vocabulary: str, lang_col: str = "lang", usable: Column | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities[piece, language])."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, 1):
                words = cut_words(part.column(1))
                raw, owner = words.data.tobytes(), np.repeat(np.arange(part.num_rows), np.diff(words.ptr))
                names = part.column(0).to_pylist()
                seen: dict[tuple[str, bytes], int] = {}
                for d, a, b in zip(owner.tolist(), words.start.tolist(), words.stop.tolist(), strict=True):
                    key = names[d], raw[a:b]
                    seen[key] = seen.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"]
                )

    sample = training(docs, lang_col, F.lit(True) if usable is None else usable).select("lang", "text")
    found = written(sample.mapInArrow(count, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    langs = sorted(r.lang for r in found.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    size = pieces_of(vocabulary).size
    probs: np.ndarray | None = None
    for _ in range(ROUNDS + 1 if langs else 0):
        total = np.zeros((size, len(langs)))
        for r in _expected(found, vocabulary, langs, probs).collect():  # one row a language and piece
            total[r.piece, r.lang] = r.n
        total += PRIOR
        probs = total / total.sum(axis=0)
    drop_written(found)
    return langs, probs if probs is not None else np.zeros((size, 0))


def _expected(found: DataFrame, vocabulary: str, langs: list[str], probs: np.ndarray | None) -> DataFrame:
    """(lang, piece, n): expected counts of pieces in the word counts, summed on the executors."""
    number = {lang: i for i, lang in enumerate(langs)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            names = np.array([number[x] for x in batch.column(0).to_pylist()])
            for k in np.unique(names).tolist():
                mine = batch.filter(pa.array(names == k))
                words, counts = mine.column(1).to_pylist(), mine.column(2).to_numpy().astype(float)
                stop = np.cumsum([len(w) for w in words], dtype=np.int64)
                start = stop - np.array([len(w) for w in words], dtype=np.int64)
                into = total.setdefault(k, np.zeros(pieces.size))
                for at, rows, sizes in groups(np.frombuffer(b"".join(words), dtype=np.uint8), start, stop):
                    expected(Lattice(pieces, rows), None if probs is None else probs[:, k], sizes, counts[at], into)
        for k, into in total.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(into[at])], names=["lang", "piece", "n"])

    return found.mapInArrow(scan, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def word_scores(pieces: Pieces, probs: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """[word, language]: the log probability of each word, all segmentations summed."""
    out = np.zeros((len(start), probs.shape[1]))
    for at, rows, sizes in groups(data, start, stop):
        out[at] = forward(Lattice(pieces, rows), probs, sizes)
    return out


def predict(docs: DataFrame, langs: list[str], probs: np.ndarray, vocabulary: str) -> DataFrame:
    """All columns of docs with lang_pred and score (of the named columns only text is looked at)."""
    names = docs.columns
    text_at = names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        for batch in batches:
            for part in textscan.slices(batch, text_at):
                n = part.num_rows
                letter = np.asarray(pc.fill_null(pc.match_substring_regex(part.column(text_at), r"\p{L}"), False).to_numpy(zero_copy_only=False), dtype=bool)
                pred, sure = np.full(n, "und", dtype=object), np.zeros(n)
                if langs:
                    words = cut_words(part.column(text_at))
                    _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
                    each, ptr = word_scores(pieces, probs, words.data, words.start[first], words.stop[first])[which], words.ptr
                    total = np.vstack([np.zeros((1, len(langs))), np.cumsum(each, axis=0)])
                    total = total[ptr[1:]] - total[ptr[:-1]]
                    best = total.argmax(axis=1)
                    post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    pred[letter] = np.array(langs, dtype=object)[best[letter]]
                    sure[letter] = post[letter]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(sure)], names=[*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """One in five documents, by the crc32 of the id as text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 5 == 0


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score; learnt from the documents that aren't held out."""
    langs, probs = learn(docs, vocabulary, usable=~held_out(F.col("doc_id")))
    found = predict(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), langs, probs, vocabulary)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
