"""WARC archives and their capture index by external merge.

Archives are written by Spark's text sink, so on any file system that Spark writes to and under
its commit protocol: a record's text, then CR LF CR LF, which is just how records end. Records go
to archives by size, so that no archive holds more than ``ARCHIVE_BYTES`` unless a single record
does. Equal payloads are stored once, later captures revisit.

Reading back parses each archive as a stream by its ``Content-Length``s into a run of captures,
sorted by url key, timestamp and id and numbered. The runs are dealt by ranges of that key, of
``RANGE_ROWS`` captures or so; a range puts the slices of its runs in the order of their numbers,
which a shuffle may lose, and merges them by a loser tree.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .store import discard, fresh_path, materialize

END = "\r\n\r\n"
#: Payloads under so many bytes are never revisited.
LEAST_BYTES = 100
#: Bytes of payload in an archive and records in it at most, captures in a range of the index.
ARCHIVE_BYTES, ARCHIVE_ROWS, RANGE_ROWS = 256 << 20, 5_000, 50_000


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for each row of ``pages(page_id, url, html)`` as gzipped WARC under ``path``.

    The payload is the html in UTF-8, a null one empty. Of equal payloads of ``LEAST_BYTES`` or more
    the smallest id's record is the response; the rest are revisits without a payload. A record
    without an id is a response.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("size"))
    first = rows.where(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = materialize(first.where("copies > 1").select(F.col("digest").alias("of"), "first"), "firsts")
    rows = rows.join(first, rows.digest == first.of, "left")
    revisit = F.coalesce(F.col("first") < F.col("page_id"), F.lit(False))
    head = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    # white space and control characters can't stand in a header; such a url is percent-encoded but for its reserved characters
    coded = F.regexp_replace(F.url_encode("url"), r"\+", "%20")
    for mark in "%/:?#[]@!$&'()*+,;=":
        coded = F.replace(coded, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    uri = F.when(F.length(F.coalesce("url", F.lit(""))) == 0, F.concat(F.lit("urn:page:"), name)).when(F.col("url").rlike(r"[\x00-\x20\x7f]"), coded).otherwise(F.col("url"))
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit("WARC/1.1"), head("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        head("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(":"), F.hex(F.monotonically_increasing_id()), F.lit(">"))), head("WARC-Date", when), head("WARC-Target-URI", uri),
        head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), head("Content-Type", F.lit("text/html; charset=utf-8")),
        F.when(revisit, F.concat(
            head("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
            head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            head("WARC-Payload-Length", F.col("size").cast("string")), head("Content-Length", F.lit("0")), F.lit(END),
        )).otherwise(F.concat(head("Content-Length", F.col("size").cast("string")), F.lit(END), "html")),
    )
    # archives of many small records, of fewer larger ones, and of single ones; a class without rows writes nothing
    classes = [ARCHIVE_BYTES // ARCHIVE_ROWS, ARCHIVE_BYTES // 64, None]
    sizes = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    low = -1
    for high in classes:
        if low >= sizes and low >= 0:
            break
        stored = F.when(revisit, F.lit(0)).otherwise(F.col("size"))
        some = rows.where((stored > low) & (stored <= high) if high else stored > low)
        many = max(1, ARCHIVE_BYTES // high) if high else 1
        some.select(record.alias("value")).write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", many).text(path)
        low = high


class _Stream:
    """Bytes of an archive, unpacked as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.packed, self.held = memoryview(data), data[:2] == b"\x1f\x8b", bytearray()
        self.at = self.gone = 0
        self.z = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        """Unpack some more; False at the end."""
        part = self.z.unconsumed_tail if self.z else b""
        if not part:
            part = bytes(self.data[self.at : self.at + (1 << 18)])
            self.at += len(part)
        if not part:
            rest = self.z.flush() if self.z else b""
            self.z = None
            self.held += rest
            return bool(rest)
        if not self.packed:
            self.held += part
            return True
        self.held += self.z.decompress(part, 1 << 20)
        if self.z.eof:  # the next member
            self.at -= len(self.z.unused_data)
            self.z = zlib.decompressobj(31) if self.at < len(self.data) else None
        return True

    def find(self, mark: bytes) -> int:
        begin = 0
        while (k := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1
        return k

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.gone += len(out)
        return out


def parse_archive(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and payload of each record of an archive, gzipped or not."""
    end, stream = END.encode(), _Stream(data)
    while stream.held or stream.more():
        at, cut = stream.gone, stream.find(end)
        if cut < 0:
            if not stream.held and not stream.more():
                return
            raise ValueError(f"the record at {at} is cut short")
        lines = stream.take(cut + len(end))[:cut].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        payload = stream.take(size)
        if len(payload) != size or stream.take(len(end)) != end:
            raise ValueError(f"the record at {at} is cut short")
        yield at, stream.gone - at, headers, payload


def url_key(url: str) -> str:
    """The url with its host's labels reversed, so that captures of a site stand together."""
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)(.*)$", url.lower(), re.DOTALL)
    if not m:
        return url.lower()
    host = re.sub(r":\d+$", "", m[1].removeprefix("www."))
    return ",".join(reversed(host.split("."))) + ")" + (m[2].split("#")[0] or "/")


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of each match, so a step replays one path."""

    def __init__(self, runs: Iterable[Iterable], key: Callable = lambda x: x):
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.k = len(self.runs)
        self.heads = [self._next(i) for i in range(self.k)]

    def _next(self, i: int):
        x = next(self.runs[i], None)
        return (x is None, None if x is None else self.key(x), i, x)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x[:1] + x[2:3] < y[:1] + y[2:3] if x[0] or y[0] else (x[1], a) < (y[1], b)

    def __iter__(self):
        k = self.k
        if not k:
            return
        loser, winner = [0] * k, [0] * (2 * k)
        for i in range(k):
            winner[k + i] = i
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], loser[node] = (a, b) if self._less(a, b) else (b, a)
        top = winner[1] if k > 1 else 0
        while not self.heads[top][0]:
            yield self.heads[top][3]
            self.heads[top] = self._next(top)
            node = (k + top) // 2
            while node:
                if self._less(loser[node], top):
                    loser[node], top = top, loser[node]
                node //= 2


CAPTURES = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long, record_length long, position long"


#: A place within a range is so many bits, the range above them.
_SHIFT = 33


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)(?::[0-9A-F]+)?>", urn or "")
    return int(m[1]) if m else None


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in CAPTURES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``, each archive a run in the order of the index.

    Size and digest of a response come from its payload as read; a digest that differs from the
    record's header is an error. Those of a revisit come from its headers.
    """

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                run = []
                for at, length, h, payload in parse_archive(data.as_py()):
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    size = len(payload)
                    if h["warc-type"] == "revisit":
                        size = int(h["warc-payload-length"])
                    elif hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"a payload of {name} differs from its digest")
                    url = "" if h["warc-target-uri"].startswith("urn:page:") else h["warc-target-uri"]
                    run.append((url_key(url), h["warc-date"], _number(h["warc-record-id"]), size, digest, h["warc-type"], _number(h.get("warc-refers-to")), name.as_py(), at, length))
                run.sort(key=_order)
                run = [(*row, k) for k, row in enumerate(run)]
                for k in range(0, len(run), 10_000):
                    yield _rows(run[k : k + 10_000])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    return files.mapInArrow(K.tidy(parse), CAPTURES)


def merge_captures(captures: DataFrame) -> DataFrame:
    """Globally ordered capture histories: ranges of (url key, timestamp, id), each merged from the slices of its sorted runs.

    A task holds the captures of its range (``RANGE_ROWS`` or so), without their payloads. ``place`` is
    a capture's place, from 0, in the history of all.
    """
    spark = captures.sparkSession

    def merge(batches):
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(row[7], []).append(row)
        for run in runs.values():
            if any(a[10] > b[10] for a, b in zip(run, run[1:], strict=False)):  # fetched in parts
                run.sort(key=lambda row: row[10])
        out, place = [], TaskContext.get().partitionId() << _SHIFT
        for row in LoserTree([runs[name] for name in sorted(runs)], _order):
            out.append((*row[:10], place))
            place += 1
            if len(out) == 10_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    captures = materialize(captures, "runs")
    ranges = max(1, -(-captures.count() // RANGE_ROWS))
    order = ("url_key", "captured", "page_id", "archive", "position")  # unlike for any two captures
    merged = materialize(captures.repartitionByRange(ranges, *order).mapInArrow(K.tidy(merge), CAPTURES), "merged")
    discard(captures)
    part, before, shifts = F.shiftright("position", _SHIFT), 0, []
    for r in sorted(merged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each range
        shifts.append((r.part, before))
        before += r.n
    shifts = F.broadcast(spark.createDataFrame(shifts, "part long, shift long"))
    place = F.col("position").bitwiseAND(F.lit((1 << _SHIFT) - 1)) + F.col("shift")
    return merged.withColumn("part", part).join(shifts, "part").withColumn("place", place).drop("part", "shift", "position")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and return the ordered captures.

    Null html counts as an empty payload, a null url as an empty one; null ids give responses.
    Repeated rows each get a record; of equal ids with equal payloads all are responses. A payload
    of any length is a record of its own and read back whole. Other columns are ignored, whatever
    their names; an empty table gives no captures.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    return merge_captures(read_captures(spark, path))


#: DuckDB SQL for the query's rows, with the index key, the timestamp and the place in the order of both.
ORACLE = """
WITH p AS (SELECT page_id, lower(url) AS low, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  strftime(to_timestamp(1704067200 + page_id % 1000000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first,
  regexp_extract(low, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_replace(low, '^[a-z][a-z0-9+.-]*://[^/?#]*', '') AS rest FROM p),
k AS (SELECT *, array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(host, '^www[.]', ''), ':[0-9]+$', ''), '.')), ',') || ')'
  || CASE WHEN split_part(rest, '#', 1) = '' THEN '/' ELSE split_part(rest, '#', 1) END AS url_key FROM m)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to,
       url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS place
FROM k"""
