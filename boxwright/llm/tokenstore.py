"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order.  Its layout:

    magic | blocks | sparse index | Bloom filter | footer

A block is a run of entries of about ``BLOCK`` bytes, closed by the crc32 of what
it holds.  An entry is: bytes shared with the previous key (u8), bytes that follow
(u8), value length (u32), key rest, value; a block's first key is whole.  A key is
the identifier in nine bytes that sort as the identifiers do (a null first); a
value is the document's ids, little-endian, two bytes each where the vocabulary
allows and four otherwise.  The sparse index has each block's first key, offset
and length; the Bloom filter answers for keys; the fixed-size footer says where
they are.  So a lookup reads the footer, the filter and the index, finds the block
by binary search and reads one block.

Each attempt of a task writes a file of its own; the manifest names those of the
attempts that Spark counts, and the others are removed, so a lost or repeated task
leaves no half shard and nothing is renamed.

Texts are encoded whole, so a worker holds the pieces and ids of the longest text.  Defined
results: a null text is encoded as empty, so has the end id alone; rows of one
identifier (or none) are kept, in the order of their texts' hashes; an empty table
gives no shards.  Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, filesystem, written

MAGIC = b"BWSST\x00\x01\n"
BLOCK = 64 << 10
BLOOM_BITS = 10
FOOTER = struct.Struct("<QQQQQQBI")  # index at, bloom at, blocks, entries, tokens, bloom bytes, id width, crc32 of the rest
_ENTRY = struct.Struct("<BBI")
#: Text bytes to a shard.
SHARD_BYTES = 128 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key[::-1]) * 2654435761 % (1 << 32) | 1
    return [(a + k * b) % bits for k in range(7)]


class ShardWriter:
    """Writes one shard to an open binary sink, entry by entry in key order."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[int] = []
        self.entries = self.tokens = 0
        self.low = self.high = b""
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if self.high and key < self.high:
            raise ValueError("keys must come in order")
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        if not self.block:
            self.first = key
        self.block += _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.low = self.low or key
        self.last = self.high = key
        self.entries += 1
        self.tokens += len(value) // self.width
        self.keys.append(zlib.crc32(key) | (zlib.adler32(key[::-1]) * 2654435761 % (1 << 32) | 1) << 32)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.first, self.at, len(self.block) + 4))
            self._put(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(key + struct.pack("<QI", at, n) for key, at, n in self.index))
        bloom_at, size = self.at, max(8, (len(self.keys) * BLOOM_BITS + 7) // 8)
        bits = np.zeros(size * 8, dtype=bool)
        seen = np.array(self.keys, dtype=np.uint64)
        a, b = seen & np.uint64(0xFFFFFFFF), seen >> np.uint64(32)
        for k in range(7):
            bits[(a + np.uint64(k) * b) % np.uint64(size * 8)] = True
        self._put(np.packbits(bits).tobytes())
        head = FOOTER.pack(index_at, bloom_at, len(self.index), self.entries, self.tokens, size, self.width, 0)[:-4]
        self._put(head + struct.pack("<I", zlib.crc32(head)) + MAGIC)


class ShardReader:
    """Reads one shard from a random-access file."""

    def __init__(self, file):
        self.file = file
        self.size = file.size()
        tail = self._at(self.size - FOOTER.size - len(MAGIC), FOOTER.size + len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC or struct.unpack("<I", tail[FOOTER.size - 4 : FOOTER.size])[0] != zlib.crc32(tail[: FOOTER.size - 4]):
            raise ValueError("not a whole shard")
        self.index_at, self.bloom_at, n, self.entries, self.tokens, self.bloom_bytes, self.width, _ = FOOTER.unpack(tail[: FOOTER.size])
        raw = self._at(self.index_at, n * 21)
        self.index = [(raw[i : i + 9], *struct.unpack("<QI", raw[i + 9 : i + 21])) for i in range(0, len(raw), 21)]

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n = self.index[i]
        raw = self._at(at, n)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        p, key = 0, b""
        while p < n - 4:
            shared, rest, size = _ENTRY.unpack_from(raw, p)
            p += _ENTRY.size
            key = key[:shared] + raw[p : p + rest]
            yield key, raw[p + rest : p + rest + size]
            p += rest + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.width}").astype("<u4")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays under an identifier (more than one if its rows repeat)."""
        key = key_of(doc_id)
        bloom = self._at(self.bloom_at, self.bloom_bytes)
        if not all(bloom[p // 8] >> (7 - p % 8) & 1 for p in _probes(key, self.bloom_bytes * 8)):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:  # the first block whose first key isn't below the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        found = []
        for i in range(max(0, lo - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            found += [self.ids(v) for k, v in self.block(i) if k == key]
        return found


def _agreeing(split, head: str, chars: str) -> str:
    """Those characters that the library keeps in one piece with head."""
    if len(split(head + chars)) == 1:
        return chars
    if len(chars) == 1:
        return ""
    mid = len(chars) // 2
    return _agreeing(split, head, chars[:mid]) + _agreeing(split, head, chars[mid:])


def _ranges(chars: str) -> str:
    """The inside of a character class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{lo:04x}-\\u{hi:04x}" for lo, hi in out)


class Pieces(dict):
    """Ids of pieces, each encoded by the library's model when it is first met; the last ``HELD`` to twice as many are kept."""

    HELD, LONGEST = 300_000, 100

    def __init__(self, library, width: int):
        split = library.pre_tokenizer.pre_tokenize_str
        self.tokenize, self.old, self.code = library.model.tokenize, {}, "H" if width == 2 else "I"
        # how the library writes each byte, read off characters that hold every byte of valid UTF-8
        bytes_as = ["\ufffd"] * 256
        for c in [*range(0x800), 0x800, *range(0x1000, 0xD000, 0x1000), 0xD000, 0xE000, 0xF000, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000]:
            for byte, char in zip(chr(c).encode(), "".join(x for x, _ in split(chr(c))), strict=True):
                bytes_as[byte] = char
        self.bytes_as = "".join(bytes_as)
        # classes of assigned characters of the basic plane, less those of which the library thinks otherwise
        kinds: dict[str, list[str]] = {"L": [], "N": [], "Z": [], "": []}
        for c in map(chr, range(0x10000)):
            kind = unicodedata.category(c)
            if kind not in ("Cn", "Co", "Cs"):
                kinds["Z" if c in "\t\n\v\f\r\x85" else kind[0] if kind[0] in "LNZ" else ""].append(c)
        letters, numbers, spaces, others = (_agreeing(split, head, "".join(kinds[k])) for head, k in (("a", "L"), ("1", "N"), ("\t", "Z"), ("!", "")))
        self.unknown = re.compile(f"[^{_ranges(letters + numbers + spaces + others)}]")
        self.cuts = self._cuts(*map(_ranges, (letters, numbers, spaces)))
        self.plain_cuts = self._cuts("A-Za-z", "0-9", r" \t\n\v\f\r")
        # the rule itself, on a text in which each alternative wins and loses
        text = "it's we'll 'tis '' 's  they've\n\n b\t c1x 23 !?'re -'d\r\n I'm a1!  'S _x_ ' t   "
        cut = [text[i:j] for _, (i, j) in split(text)]
        self.exact = not self.unknown.search("".join(map(chr, range(128)))) and self.cuts(text) == self.plain_cuts(text) == cut

    @staticmethod
    def _cuts(letter: str, number: str, space: str):
        """Contractions go before other signs, the only alternative that they compete with, so the order is otherwise free."""
        return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall

    @staticmethod
    def serve(library) -> bool:
        """Whether a text's ids are those of its pieces in turn, and cut by the one rule known here."""
        made = json.loads(library.to_str())
        cut, after, model = made["pre_tokenizer"] or {}, made["post_processor"] or {"type": "ByteLevel"}, made["model"]
        return (
            not (made["normalizer"] or made["truncation"] or made["padding"] or model.get("dropout"))
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
            and (model["type"], after["type"]) == ("BPE", "ByteLevel")
        )

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = [x.id for x in self.tokenize(piece.encode().decode("latin-1").translate(self.bytes_as))]
            ids = struct.pack(f"<{len(found)}{self.code}", *found)
        if len(piece) <= self.LONGEST:
            if len(self) >= self.HELD:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes | None:
        """None where a character is not known."""
        if text.isascii():
            return b"".join(map(self.__getitem__, self.plain_cuts(text)))
        return None if self.unknown.search(text) else b"".join(map(self.__getitem__, self.cuts(text)))


class Encoder:
    """The library's ids of whole texts, special tokens found as it finds them and none added.

    A byte-level BPE encodes each piece that its pre-tokenizer cuts for itself, so a text's
    ids are its pieces' ids in turn, and each piece needs the library once.  The pieces are
    cut here, by classes of characters that are compared with the library's own cuts when a
    worker starts.  The library gets whole texts where that isn't known to hold: any other
    kind of tokenizer, texts with the content of an added token, and texts with a character
    beyond the basic plane, unassigned or classed otherwise by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if max(self.library.get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        pieces = Pieces(self.library, self.width) if Pieces.serve(self.library) else None
        self.pieces = pieces if pieces is not None and pieces.exact else None

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [None if self.pieces is None or any(x in t for x in self.added) else self.pieces.encode(t) for t in texts]
        whole = [i for i, ids in enumerate(out) if ids is None]
        if whole:
            for i, x in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = np.array(x.ids, dtype=f"<u{self.width}").tobytes()
        return out


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


MANIFEST = "shard int, file string, n_docs bigint, n_tokens bigint, bytes bigint, first_id bigint, last_id bigint"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends the end id and writes shards in ascending key order; returns the manifest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    placed = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .textscan import slices

        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        words = encoder(tokenizer)
        end = np.array([end_id], dtype=f"<u{words.width}").tobytes()
        store, root = filesystem(folder)
        out = None
        for batch in batches:
            for part in slices(batch, 1):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name = f"shard-{shard:06d}-{attempt}.sst"
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                    out = ShardWriter(sink, words.width)
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    out.add(key_of(doc_id), ids + end)
        if out is not None:
            out.close()
            sink.close()
            row = [shard, f"{folder}/{name}", out.entries, out.tokens, out.at, id_of(out.low), id_of(out.high)]
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    with arrow_rows(spark, 2000):
        manifest = written(placed.mapInArrow(write, MANIFEST), "manifest")
    _drop_unlisted(manifest, folder)
    return manifest


def _drop_unlisted(manifest: DataFrame, folder: str) -> None:
    """Removes what failed attempts left; the names are gathered only where there is such a file."""
    from pyarrow import fs

    store, root = filesystem(folder)
    files = [x.path for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    if len(files) > manifest.count():
        listed = {r.file.rsplit("/", 1)[-1] for r in manifest.select("file").collect()}
        for path in files:
            if path.rsplit("/", 1)[-1] not in listed:
                store.delete_file(path)


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, file.

    Offsets come from the shards' own totals, so no document crosses the network.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = filesystem(uri)
                with store.open_input_file(at) as file:
                    reader, total = ShardReader(file), start
                    for i in range(len(reader.index)):
                        keys, starts, sizes, crcs = [], [], [], []
                        for key, value in reader.block(i):
                            ids = reader.ids(value)
                            keys.append(id_of(key))
                            starts.append(total)
                            sizes.append(len(ids))
                            crcs.append(zlib.crc32(ids.tobytes()))
                            total += len(ids)
                        n = len(keys)
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(x, pa.int64()) for x in (keys, starts, sizes, crcs)), pa.array([shard] * n, pa.int32()), pa.array([uri] * n)],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "file"],
                        )

    spread = placed.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int, file string")


def lookup(spark: SparkSession, manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The id arrays of one identifier (or of none): the manifest names the shards, a binary search the block."""
    found = []
    inside = F.col("first_id").isNull() if doc_id is None else F.coalesce("first_id", F.lit(-(1 << 63))).cast("bigint") <= doc_id
    holding = inside if doc_id is None else inside & (F.col("last_id") >= doc_id)
    for row in manifest.where(holding).orderBy("shard").collect():
        store, at = filesystem(row.file)
        with store.open_input_file(at) as file:
            found += ShardReader(file).get(doc_id)
    return found
