"""WARC archives with an external merge of their capture index.

Writing: each task writes one archive of gzipped records and one run, its captures
sorted by URL key and timestamp, both moved to their names when whole.  Merging:
splitters from the runs' sparse samples cut the key space into ranges; a task opens
its range of every run, at the place the run's own sample gives, and merges them with
a loser tree, so memory holds one block of each run.  Where there are more runs than
``FAN_IN`` they are merged in passes.  The ranges end to end are the captures of all
archives in order of URL key, timestamp and record.

Which record is a response is settled before writing: of equal payloads the smallest
id is kept and the others point at it.  Only the ids of later copies travel.

Defined results: a null payload is empty; a null URL has the empty URL key; rows
without an id keep their payload as responses and are no one's reference; of repeated
rows of one id all are written, the first of them (in one group: those with the
smallest id) as responses; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, written

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: Lines of a run between two entries of its sample, runs that one pass merges, and lines of a merge range.
EVERY = 256
FAN_IN = 512
RANGE_LINES = 10_000


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels reversed, then path and sorted query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    labels = [x for x in host.split(".") if x]
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(labels))}{port}){parts.path or '/'}{'?' + query if query else ''}".lower()


def captured_at(page_id: int | None) -> datetime:
    """The synthetic tables have no capture time; one second a record stands for it."""
    return EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One gzipped record and its payload digest."""
    name = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {captured_at(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{name}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    head.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush(), name


def parse(raw: bytes) -> dict:
    """A record's named fields, its payload and the payload length that its HTTP head declares."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    declared = next(int(x.partition(b": ")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "declared": declared}


def _id(uri: str | None) -> int | None:
    name = (uri or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if name == "none" else int(name)


def line_key(line: dict) -> str:
    """Sorts lines by URL key, time and record id; as strings sort by code point, here and in Spark alike."""
    order = 0 if line["id"] is None else line["id"] + (1 << 63)
    return f"{line['key']}\x00{line['time']}\x00{order:020d}\x00{line['file']}\x00{line['offset']:015d}"


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next line costs one path of matches."""

    def __init__(self, runs: list[Iterator[dict]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads: list[str | None] = [None] * self.k
        self.lines: list[dict | None] = [None] * self.k
        for i in range(self.k):
            self._pull(i)
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, filling=True)

    def _pull(self, i: int) -> None:
        line = next(self.runs[i], None)
        self.lines[i], self.heads[i] = line, None if line is None else line_key(line)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def _play(self, i: int, filling: bool = False) -> None:
        at = (i + self.k) // 2
        while at > 0:
            other = self.losers[at]
            if other < 0 and filling:
                self.losers[at] = i
                return
            if other >= 0 and self._beats(other, i):
                self.losers[at], i = i, other
            at //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[dict]:
        while self.k:
            top = self.losers[0]
            line = self.lines[top]
            if line is None:
                return
            yield line
            self._pull(top)
            self._play(top)


def _write_whole(folder: str, name: str, attempt: int, write) -> str:
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/.attempt-{attempt}-{name}", compression=None) as sink:
        write(sink)
    store.move(f"{root}/.attempt-{attempt}-{name}", f"{root}/{name}")
    return f"{folder}/{name}"


_FOOT = struct.Struct("<QQ4s")


def write_run(folder: str, name: str, attempt: int, lines: Iterator[dict]) -> tuple[str, int]:
    """Writes sorted lines, then the sparse sample of their keys and a footer; returns the file and the number of lines."""
    sample: list[list] = []
    n = at = 0

    def write(sink) -> None:
        nonlocal n, at
        for line in lines:
            if n % EVERY == 0:
                sample.append([line_key(line), at])
            raw = json.dumps(line, separators=(",", ":")).encode() + b"\n"
            sink.write(raw)
            at += len(raw)
            n += 1
        sink.write(json.dumps(sample).encode() + _FOOT.pack(at, n, b"RUN1"))

    return _write_whole(folder, name, attempt, write), n


def run_sample(file) -> tuple[list[list], int]:
    """The sample of a run and where its lines end."""
    file.seek(file.size() - _FOOT.size)
    end, _, magic = _FOOT.unpack(file.read(_FOOT.size))
    if magic != b"RUN1":
        raise ValueError("not a whole run")
    file.seek(end)
    return json.loads(file.read(file.size() - _FOOT.size - end)), end


def read_run(uri: str, low: str | None = None, high: str | None = None) -> Iterator[dict]:
    """The lines of a run with low <= key < high, read from the last sampled place before them."""
    store, path = filesystem(uri)
    with store.open_input_file(path) as file:
        sample, end = run_sample(file)
        at = 0
        if low is not None and sample:
            at = sample[max(0, bisect.bisect_right([k for k, _ in sample], low) - 1)][1]
        file.seek(at)
        rest = b""
        while at < end:
            block = file.read(min(1 << 16, end - at))
            at += len(block)
            *whole, rest = (rest + block).split(b"\n")
            for text in whole:
                line = json.loads(text)
                key = line_key(line)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield line


_RUN = "file string, n bigint, keys array<string>"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row and each task's sorted run; returns the runs (file, n, sampled keys)."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    firsts = rows.where("page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    later = written(rows.select("page_id", "digest").join(firsts, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "later")
    settled = rows.join(later, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .textscan import slices

        task = TaskContext.get()
        name, lines, at = f"part-{task.partitionId():06d}", [], 0
        file = f"{folder}/{name}.warc.gz"

        def put(sink) -> None:
            nonlocal at
            for batch in batches:
                for part in slices(batch, 2):
                    for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        raw, sha = record(page_id, url, html.encode(), refers_to)
                        sink.write(raw)
                        lines.append({"key": url_key(url), "time": f"{captured_at(page_id):%Y%m%d%H%M%S}", "id": page_id, "digest": sha, "file": file, "offset": at, "length": len(raw)})
                        at += len(raw)

        _write_whole(folder, f"{name}.warc.gz", task.taskAttemptId(), put)
        lines.sort(key=line_key)
        run, n = write_run(folder, f"{name}.run", task.taskAttemptId(), iter(lines))
        if n:
            yield _run_row(run, n, [line_key(x) for x in lines[::EVERY]])

    return written(settled.mapInArrow(write, _RUN), "runs")


def _run_row(file: str, n: int, keys: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n]), pa.array([keys], pa.list_(pa.string()))], names=["file", "n", "keys"])


def _fewer(runs: DataFrame, folder: str, level: int) -> DataFrame:
    """One pass over groups of ``FAN_IN`` runs: each becomes one run."""
    groups = runs.select("file", F.pmod(F.xxhash64("file"), F.lit(-(-runs.count() // FAN_IN))).alias("g")).groupBy("g").agg(F.sort_array(F.collect_list("file")).alias("files"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for batch in batches:
            for g, files in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys: list[str] = []

                def lines(files=files, keys=keys):
                    for i, line in enumerate(LoserTree([read_run(f) for f in files])):
                        if i % EVERY == 0:
                            keys.append(line_key(line))
                        yield line

                run, n = write_run(folder, f"pass-{level}-{g:06d}.run", TaskContext.get().taskAttemptId(), lines())
                yield _run_row(run, n, keys)

    return written(groups.select("g", "files").mapInArrow(merge, _RUN), "runs")


def merge_runs(runs: DataFrame, folder: str, lines: int = RANGE_LINES) -> DataFrame:
    """Merges all runs; returns the captures in order: url_key, timestamp, page_id, digest, file, offset, length, range, place.

    ``place`` is a capture's rank among all.
    """
    spark, level = runs.sparkSession, 0
    while runs.count() > FAN_IN:
        runs, level = _fewer(runs, folder, level), level + 1
    files = sorted(r.file for r in runs.select("file").collect())  # FAN_IN at most
    total = runs.agg(F.sum("n")).first()[0] or 0
    lines = max(lines, total // 10_000)  # so there are some 10,000 ranges at most
    sampled = runs.select(F.explode("keys").alias("k"))
    cuts = sorted({r.k for r in sampled.where(F.pmod(F.xxhash64("k"), F.lit(max(1, lines // EVERY))) == 0).collect()})
    ranges = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))], "range int, low string, high string")
    ranges = ranges.repartition(len(cuts) + 1, "range")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: list[dict] = []
                for place, line in enumerate(LoserTree([read_run(f, low, high) for f in files])):
                    held.append(line | {"range": i, "place": place})
                    if len(held) == 10_000:
                        yield _captures(held)
                        held = []
                if held:
                    yield _captures(held)

    merged = written(ranges.mapInArrow(merge, _CAPTURE), "captures")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return merged.join(F.broadcast(first), "range").withColumn("place", F.col("first") + F.col("place")).drop("first")  # a row a range


_CAPTURE = "url_key string, timestamp string, page_id bigint, digest string, file string, offset bigint, length bigint, range int, place bigint"


def _captures(lines: list[dict]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    fields = ["key", "time", "id", "digest", "file", "offset", "length", "range", "place"]
    return pa.RecordBatch.from_arrays([pa.array([x[f] for x in lines], k) for f, k in zip(fields, kinds, strict=True)], names=[x.split()[0] for x in _CAPTURE.split(", ")])


def read_records(captures: DataFrame) -> DataFrame:
    """Reads each capture's record from its archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, timestamp, place.

    Captures are dealt by archive and read in the order in which they lie there; a
    response's digest is computed again and must be the one recorded.
    """
    spark = captures.sparkSession
    dealt = captures.select("file", "offset", "length", "url_key", "timestamp", "place")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            out: list[tuple] = []
            for name, offset, length, key, time, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != uri:
                    if file is not None:
                        file.close()
                    store, path = filesystem(name)
                    uri, file = name, store.open_input_file(path)
                file.seek(offset)
                x = parse(gzip.decompress(file.read(length)))
                recorded = x["warc-payload-digest"].removeprefix("sha1:")
                if x["warc-type"] == "response" and (digest(x["payload"]) != recorded or len(x["payload"]) != x["declared"]):
                    raise ValueError(f"a damaged record in {name} at {offset}")
                out.append((_id(x["warc-record-id"]), x["declared"], recorded, x["warc-type"], _id(x.get("warc-refers-to")), key, time, place))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _RECORD.split(", ")])
        if file is not None:
            file.close()

    return dealt.mapInArrow(read, _RECORD)


_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string, timestamp string, place bigint"
